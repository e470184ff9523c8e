"""The whole check, its reports, settings, sources, streams and the command line."""

import json
import os

import pytest

from prosegrain import config as settings
from prosegrain.__main__ import main
from prosegrain.config import Config
from prosegrain.operators import coinage, report
from prosegrain.plans import catalog
from prosegrain.plans.check import check
from prosegrain.plans.fixtures import DOCUMENTS, MORPHEMES
from prosegrain.sources import documents, lexicons
from prosegrain.sources.folders import markdown_files
from prosegrain.streaming.checks import check_stream

DOCS = "file string, kind string, raw string"


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(f, "md", t) for f, t in DOCUMENTS], DOCS)
    return check(docs, Config(register="consume", deny={"禁句": "別の言葉"}, katakana=(("latency", "レイテンシ"),), jargon=("campaign",))).cache()


def test_findings(found):
    rows = found.collect()
    assert {r["severity"] for r in rows} == {"error", "advisory"}
    by_rule = {r["rule"] for r in rows}
    assert {"denied-term", "slop-phrase", "latin-token", "sentence-length", "near-duplicate", "jargon-export", "arrow"} <= by_rule
    assert next(json.loads(r["data"]) for r in rows if r["rule"] == "denied-term") == {"word": "禁句", "suggestion": "別の言葉"}
    assert any("レイテンシ" in r["message"] for r in rows if r["rule"] == "latin-token")


def test_markers_silence_their_line_and_the_next(found):
    assert sorted(r["line"] for r in found.where("file = 'f21' and rule = 'exclamation'").collect()) == [3, 6]


def test_registers(spark):
    docs = spark.createDataFrame([("f", "md", "結果は latency で見る。")], DOCS)
    got = {r: [x["severity"] for x in check(docs, Config(register=r), {"codemix"}, keep=False).where("rule = 'latin-token'").collect()] for r in ("internal", "external", "consume")}
    assert got == {"internal": [], "external": ["advisory"], "consume": ["error"]}
    with pytest.raises(ValueError, match="register"):
        Config(register="other")


def test_reports(found):
    n = report.totals(found).first()
    whole = json.loads(report.json_report(found))
    assert whole["summary"] == {"error": n["error"], "advisory": n["advisory"]} and whole["version"] == 1
    places = [(f["file"], f["line"]) for f in whole["findings"]]
    assert places == sorted(places) and not any("data" in f and f["data"] is None for f in whole["findings"])
    assert all(line.startswith(("::error file=", "::notice file=")) for (line,) in report.annotations(found).collect())
    assert report.text_lines(found).count() == len(places)
    assert report.rolled_up(found).where("detector is null").first()["n"] == len(places)


def test_coinages(spark):
    morphemes = spark.createDataFrame(MORPHEMES, coinage.SCHEMA)
    strict = {r["compound"] for r in coinage.coinages(morphemes).where("strict").collect()}
    assert strict == {"家造語", "slop軸", "機械床"}
    known = spark.createDataFrame([("家造語",)], "word string")
    assert "家造語" not in {r["compound"] for r in coinage.coinages(morphemes, corpus=known).collect()}
    lines = spark.createDataFrame([("f", 1, "機械床")], "file string, line int, text string")
    made = coinage.tokenized(lines, lambda s: [coinage.Morpheme(s[:2], "名詞", "普通名詞", "一般"), coinage.Morpheme(s[2:], "名詞", "普通名詞", "一般")])
    assert [r["compound"] for r in coinage.coinages(made).collect()] == ["機械床"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("一。")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.md").write_text("二。")
    (tmp_path / "c.html").write_text("<p>三</p>")
    assert sorted(r["raw"] for r in documents.from_folder(spark, str(tmp_path)).collect()) == ["一。", "二。"]
    assert [r["raw"] for r in documents.from_folder(spark, str(tmp_path), ["sub"]).collect()] == ["一。"]
    assert {(r["kind"], r["raw"]) for r in documents.from_files(spark, [str(tmp_path / "c.html")]).collect()} == {("html", "<p>三</p>")}
    diff = "+++ b/x.md\n@@ -1,0 +5,2 @@\n+甲\n+乙\n@@ -9 +20 @@\n-古\n+新\n+++ b/y.md\n@@ -0,0 +1 @@\n+丙"
    got = documents.added_lines(spark.createDataFrame([(1, diff)], "id int, text string")).collect()
    assert sorted(map(tuple, got)) == [("x.md", 5, "甲"), ("x.md", 6, "乙"), ("x.md", 20, "新"), ("y.md", 1, "丙")]


def test_lexicons(spark, tmp_path):
    (f := tmp_path / "l.tsv").write_text("# c\n a\tb\tc\n\nsolo\na\tx\n")
    assert lexicons.pairs(f) == [("a", "b\tc"), ("solo", ""), ("a", "x")] and lexicons.pairs(tmp_path / "none") == []
    assert len(lexicons.pairs(lexicons.SHIPPED / "metaphors.tsv")) == 28 and len(lexicons.pairs(lexicons.SHIPPED / "katakana.tsv")) == 98
    assert {r["word"] for r in lexicons.corpus_words(spark, str(f)).collect()} == {"a", "solo"}
    registry = "| `alpha-beta (x)` | home |\n| `Gamma` second | y |\n| plain | z |"
    assert lexicons.registry_heads(registry) == ["alpha-beta", "Gamma"] and "gamma" in lexicons.registry_words(registry)
    assert lexicons.registry_cells(registry) == {"alpha-beta (x)", "alpha-beta", "Gamma"}


def test_settings(tmp_path):
    (tmp_path / "deny.tsv").write_text("悪い\t良い\n重い\t軽い\n")
    (tmp_path / settings.FILE_NAME).write_text('register = "external"\ndeny-vocabulary = ["deny.tsv"]\n[deny]\n"悪い" = "別"\n[readability]\nmax-ten = 2\n')
    (tmp_path / "deep/er").mkdir(parents=True)
    c = settings.load(settings.discover(tmp_path / "deep/er"), max_sentence=50)
    assert (c.register, c.deny, c.max_ten, c.max_sentence) == ("practice", {"悪い": "別", "重い": "軽い"}, 2, 50)
    (tmp_path / settings.FILE_NAME).write_text("odd = 1\n")
    with pytest.raises(ValueError, match="odd"):
        settings.load(tmp_path / settings.FILE_NAME)


def test_stream(spark, tmp_path):
    spark.createDataFrame([("f", "md", "止まれ！")], DOCS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DOCS).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        check_stream(stream, Config(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r["rule"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["exclamation"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.md").write_text("値を計測することが可能である。\n")
    assert main(["readability", "a.md"]) == 1
    assert "readability/verbose-potential" in (out := capsys.readouterr().out) and "error 1" in out
    assert main(["readability", "a.md", "--advisory", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["error"] == 1
    assert main(["init"]) == 0 and main(["init"]) == 2
    assert main(["fix", "a.md"]) == 0
    (tmp_path / settings.FILE_NAME).write_text("odd = 1\n")
    assert main(["check", "a.md"]) == 2


def test_check_finds_coinages_with_a_tokenizer(spark, tmp_path):
    def halves(s):
        return [coinage.Morpheme(x, "名詞", "普通名詞", "一般") for x in (s[:2], s[2:])]

    (tmp_path / "words.tsv").write_text("物理層\t1\n")
    (tmp_path / settings.FILE_NAME).write_text('allow = ["判定床"]\n[deny]\n"木下軸" = "別"\n[coinage]\ncorpus = "words.tsv"\n')
    docs = spark.createDataFrame([("f", "md", "機械床\n物理層\n判定床\n木下軸\n|家造語|\n```\n機械核\n```\n機械腕 <!-- prose-ignore -->")], DOCS)
    got = check(docs, settings.load(tmp_path / settings.FILE_NAME), {"coinage"}, keep=False, tokenizer=halves).collect()
    assert [(r["line"], r["detector"], r["rule"], json.loads(r["data"])) for r in got] == [(1, "coinage", "dictionary-coinage", {"compound": "機械床", "components": ["機械", "床"]})]


def test_summary_takes_the_documents_of_the_table(spark, tmp_path):
    spark.createDataFrame([(1, "stop!"), (2, "stop! now!")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    n = {r["rule"]: r["n"] for r in catalog.findings_summary(spark, str(tmp_path)).collect()}
    hits = catalog.suppressed_exclamation(spark, str(tmp_path)).cache()
    assert n["exclamation"] == hits.count() > hits.where("file rlike '^f'").count()


def test_coinages_on_the_command_line(spark, tmp_path, monkeypatch, capsys):
    """A tokenizer from the settings, registries, a diff, and what is wrong without one."""
    import io

    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.md").write_text("機械床\n判定床\n物理層\n測定計測\n")
    assert main(["coinage", "a.md"]) == 2 and "tokenizer" in capsys.readouterr().err
    (tmp_path / "halving.py").write_text("from prosegrain.operators.coinage import Morpheme\n\ndef halves(s):\n    return [Morpheme(x, '名詞', '普通名詞', '一般') for x in (s[:2], s[2:])]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / settings.FILE_NAME).write_text('[coinage]\ntokenizer = "halving:halves"\n')
    (tmp_path / "known.md").write_text("| `判定床` | a term |\n")
    (tmp_path / "known.txt").write_text("# words\n物理層\n")
    assert main(["coinage", "a.md", "--strict", "--allow", "known.md", "--allow", "known.txt"]) == 1
    out = capsys.readouterr().out
    assert "a.md:1:" in out and "機械床" in out and all(x not in out for x in ("判定床", "物理層", "測定計測"))
    assert main(["coinage", "a.md", "--advisory"]) == 0 and "測定計測" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO("+++ b/x.md\n@@ -0,0 +7 @@\n+機械床\n"))
    assert main(["coinage", "--diff", "--strict"]) == 1 and "x.md:7:" in capsys.readouterr().out
    assert main(["check", "a.md"]) == 0 and "dictionary-coinage" in capsys.readouterr().out
    (tmp_path / settings.FILE_NAME).write_text('[coinage]\ntokenizer = "nothing:here"\n')
    assert main(["check", "a.md"]) == 2


def test_registries_allow_latin_words(spark, tmp_path):
    (tmp_path / "r.md").write_text("| `latency` | how long |\n")
    docs = spark.createDataFrame([("f", "md", "結果は latency で評価し、 query plan を見る。")], DOCS)
    word = lambda c: {r["message"].split()[-1] for r in check(docs, c, {"codemix"}, keep=False).where("rule = 'latin-token'").collect()}
    assert len(word(settings.load(None, (tmp_path / "r.md",), register="consume"))) < len(word(settings.load(None, register="consume")))


def test_folders_keep_ignore_files_and_real_names(spark, tmp_path, monkeypatch, capsys):
    for name in ("_draft.md", "日 本+%41.md", "a.txt", ".hidden.md", "build/x.md", "sub/keep.md", "sub/skip.md", "sub/deep/note.md", "sub/deep/tmp1.md", "only/file.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("止まれ！")
    (tmp_path / ".gitignore").write_text("# c\nbuild/\n/sub/skip.md\n**/tmp?.md\n*.md\n!*.md\ntmp[0-9].md\nsub/skip.md\n")
    (tmp_path / "only/.ignore").write_text("*\n")
    names = sorted(["_draft.md", "日 本+%41.md", "sub/keep.md", "sub/deep/note.md"])
    assert [os.path.relpath(f, tmp_path) for f in markdown_files(str(tmp_path))] == names
    monkeypatch.chdir(tmp_path)
    assert main(["check"]) == 0
    out = capsys.readouterr().out
    assert all(f"{n}:1: [readability/exclamation" in out for n in names) and "skip" not in out
    assert sorted(r["file"].removeprefix(f"{tmp_path}/") for r in documents.from_folder(spark, str(tmp_path / "sub")).collect()) == ["sub/deep/note.md", "sub/deep/tmp1.md", "sub/keep.md", "sub/skip.md"]
    (tmp_path / "empty").mkdir()
    assert main(["check", "empty"]) == 2 and main(["check", "gone.md"]) == 2 and "gone.md" in capsys.readouterr().err
    (tmp_path / "held").mkdir()
    (tmp_path / "held/mine").write_text("x")
    assert main(["fix", "sub/keep.md", "--out", "held"]) == 2 and (tmp_path / "held/mine").read_text() == "x"
