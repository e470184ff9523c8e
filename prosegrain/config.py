"""Settings of a check: defaults, a TOML file found on the way to the root, and what a caller passes, in rising order."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

FILE_NAME = "prosegrain.toml"
REGISTERS = ("internal", "practice", "consume")
#: The phrases and units that the rules are defined by.
DENIED = "可能性を解き放 架け橋とな 世界へようこそ いかがでした ゲームチェンジャー 魔法のよう 潜在能力を引き出 スーパーチャージ 業界を再定義 フロンティアを開拓 根本的に変革 驚嘆させ 未来を変える 新たな基準を設定".split()
UNITS = "ms s sec min h kg g mg km cm mm nm pt px dB Hz kHz MHz GHz bit bits byte bytes JA".split()


@dataclass(frozen=True)
class Config:
    """Word lists are settings, not tables: they go into the plan as literals."""

    allow: tuple[str, ...] = ()
    allow_vocabulary: tuple[str, ...] = ()
    deny: dict[str, str] = field(default_factory=dict)
    register: str = "internal"
    codemix_threshold: float = 8.0
    max_sentence: int = 100
    max_ten: int = 4
    unit_words: tuple[str, ...] = ()
    metaphors: tuple[tuple[str, str], ...] = ()
    katakana: tuple[tuple[str, str], ...] = ()
    jargon: tuple[str, ...] = ()
    ignore_marker: str = "prose-ignore"
    coinage_corpus: str = ""
    coinage_allow: tuple[str, ...] = ()
    coinage_tokenizer: str = ""

    def __post_init__(self):
        if self.register == "external":
            object.__setattr__(self, "register", "practice")
        if self.register not in REGISTERS:
            raise ValueError(f"register must be one of {', '.join(REGISTERS)}, not {self.register!r}")

    def denied(self) -> list[tuple[str, str, str]]:
        """word, suggestion, rule of the user's and of the built-in terms that are not allowed."""
        own = [(w, s, "denied-term") for w, s in sorted(self.deny.items()) if w not in self.allow]
        return own + [(w, "", "slop-phrase") for w in DENIED if w not in self.allow and w not in self.deny]


#: Where a key of the file goes; lists of files are read by their loaders.
KEYS = {
    "allow": "allow", "deny": "deny", "register": "register", "codemix.threshold": "codemix_threshold", "readability.max-sentence": "max_sentence", "readability.max-ten": "max_ten",
    "counter.unit-words": "unit_words", "deny-vocabulary": "", "codemix.allow-vocabulary": "", "codemix.katakana-lexicon": "", "rhetoric.metaphor-lexicon": "", "jargon.vocabulary": "", "coinage.corpus": "", "coinage.tokenizer": "coinage_tokenizer",
}


def discover(start: Path) -> Path | None:
    """The nearest settings file in start or a folder above it."""
    return next((p / FILE_NAME for p in [start.resolve(), *start.resolve().parents] if (p / FILE_NAME).is_file()), None)


def flat(tree: dict, prefix: str = "") -> dict:
    return {k: v for key, value in tree.items() for k, v in (flat(value, f"{prefix}{key}.").items() if isinstance(value, dict) and f"{prefix}{key}" != "deny" else [(f"{prefix}{key}", value)])}


def load(path: Path | None, registries: tuple[Path, ...] = (), **more) -> Config:
    """The settings of a file (unknown keys are errors), overridden by more.

    registries allow what they list: the latin words of a markdown registry's rows count as no English, and its first cells, or
    the lines of another file, as no coinages.
    """
    from prosegrain.sources import lexicons

    found = flat(tomllib.loads(path.read_text())) if path else {}
    if odd := sorted(set(found) - set(KEYS)):
        raise ValueError(f"unknown keys in {path}: {', '.join(odd)}")
    base = path.parent if path else Path()
    files = lambda key: [base / x for x in ([found[key]] if isinstance(found.get(key), str) else found.get(key, []))]
    got = {KEYS[k]: tuple(v) if isinstance(v, list) else v for k, v in found.items() if KEYS[k]}
    deny = {w: s for f in files("deny-vocabulary") for w, s in lexicons.pairs(f)} | dict(got.get("deny", {}))
    got |= {"deny": deny, "allow_vocabulary": tuple(sorted({w.lower() for f in files("codemix.allow-vocabulary") for w, _ in lexicons.pairs(f)}))}
    for key, name, shipped in (("rhetoric.metaphor-lexicon", "metaphors", "metaphors.tsv"), ("codemix.katakana-lexicon", "katakana", "katakana.tsv")):
        got[name] = tuple(p for f in files(key) or [lexicons.SHIPPED / shipped] for p in lexicons.pairs(f))
    got["jargon"] = tuple(dict.fromkeys(w for f in files("jargon.vocabulary") for w in lexicons.registry_heads(f.read_text())))
    got["coinage_corpus"] = str(base / Path(found["coinage.corpus"]).expanduser()) if found.get("coinage.corpus") else ""
    texts = [(f.suffix == ".md", f.read_text()) for f in map(Path, registries)]
    words = {w for _, t in texts for w in lexicons.registry_words(t)}
    got["allow_vocabulary"] = tuple(sorted({*got["allow_vocabulary"], *words}))
    got["coinage_allow"] = tuple(sorted({w for md, t in texts for w in (lexicons.registry_cells(t) if md else lexicons.plain_words(t))}))
    config = replace(Config(), **got)
    names = {f.name for f in fields(Config)}
    return replace(config, **{k: v for k, v in more.items() if k in names and v is not None})
