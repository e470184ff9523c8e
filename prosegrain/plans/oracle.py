"""DuckDB SQL for the prose queries: the scopes as windows over lines and pieces, and each rule on top."""

from __future__ import annotations

from prosegrain.plans.fixtures import DOCUMENTS

#: Fixed values, written out once more, so that a wrong one in the rules shows.
BULLET = r"(?:[-*+][ \t]|・|[0-9０-９]+[.．)])"
BLOCK = rf"^[ \t]*(?:{BULLET}|```|>|\|)"
INFLECTIONS = "する|します|した|して|している|していた|しています|しており|される|された|されて|されない|されました|できる|できた|できない|しない|しなかった|せず|しよう|すれば|すべき|しろ|せよ|させる|させます|させた|させて|させている|させたい|させない|させず|させよう|したい|したく|したければ"
CALQUE = f"(?:^|[^A-Za-z])([a-z][a-zA-Z-]+) *({INFLECTIONS})"
COLON_END = "[ぁ-ん][:：]$"
CONNECTOR = "^(?:また|さらに|そして|加えて|一方|なお|ただし|つまり|次に|まず)、"
COUNTER = "([0-9]-)?([0-9]+) ([A-Za-z][A-Za-z_-]*) ?[をがはでにとへの。、！？]"
DEMONSTRATIVE = "これ|それ|あれ|この|その|あの|ここ|そこ"
DOUBLE_NEGATIVE = "なくはな|なくもな|ないことはな|ないとは[言い]えな|ないわけではな"
HEDGE = "と思われ|と考えられ|かもしれ|のではないか|ではないだろうか|気がする|感じがする|ように思|ように見え|とみられ"
PLAIN_STYLE = "[ぁ-ん][。！？]$"
POLITE = "(?:です|ます|ません|でした|ました|ましょう|でしょう|ください)[。！？]$"
TEMPLATE = r"^[ \t]*[-*+][ \t]\*\*[^*]+\*\*[:：]"
TERMINATED = r"""[。？！」』）)"']$"""
DENIED = "可能性を解き放 架け橋とな 世界へようこそ いかがでした ゲームチェンジャー 魔法のよう 潜在能力を引き出 スーパーチャージ 業界を再定義 フロンティアを開拓 根本的に変革 驚嘆させ 未来を変える 新たな基準を設定".split()
UNITS = "ms s sec min h kg g mg km cm mm nm pt px dB Hz kHz MHz GHz bit bits byte bytes JA".split()

W = r"[\s\x{3000}]"
JA = r"[\p{Hiragana}\p{Katakana}\p{Han}]"
ASIDE = r"`[^`]*`|https?://[^\s\x{3000}]+|§[\p{Han}\p{Katakana}\p{Hiragana}0-9A-Za-z.\-]+|R\d{4}_\d+|IF-\d"


def lit(s: str) -> str:
    return "E'" + s.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"


def raw(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NL = "chr(10)"
FIXTURES = "select * from (values " + ", ".join(f"({lit(f)}, {lit(t)})" for f, t in DOCUMENTS) + ") v(file, text)"
MARKS, ALPHABET, KANA = (".!?,", "。！？、"), "etaoinshrdlu", "のたかをいんしはれでるう"
PLAIN = f"replace(translate(text, '{MARKS[0]}', '{MARKS[1]}'), {NL}, {NL} || {NL})"
CORPUS = f"""{FIXTURES} union all select 'a' || doc_id, {PLAIN} from documents
  union all select 'b' || doc_id, translate(lower({PLAIN}), '{ALPHABET}', '{KANA}') from documents"""

PRELUDE = f"""with src as ({CORPUS}),
fe as (select file, case when contains(text, '```') then array_to_string(list_transform(string_split(text, '```'), lambda x, i: case when i % 2 = 1 then x
   when i < len(string_split(text, '```')) then repeat({NL}, length(x) - length(replace(x, {NL}, ''))) else '```' || x end), '') else text end as t from src),
mk as (select file, t, case when contains(t, '`') and contains(t, '$$') then array_to_string(list_transform(string_split(t, {NL}), lambda s:
   array_to_string(list_transform(string_split(s, '`'), lambda x, i: case when i % 2 = 0 and i < len(string_split(s, '`')) then replace(x, '$', chr(64980)) else x end), '`')), {NL}) else t end as m from fe),
ma as (select file, case when contains(m, '$$') then replace(array_to_string(list_transform(string_split(m, '$$'), lambda x, i: case when i % 2 = 1 then x
   when i < len(string_split(m, '$$')) then case when contains(x, {NL} || {NL}) then '$$' || x || '$$' else repeat({NL}, length(x) - length(replace(x, {NL}, ''))) end else '$$' || x end), ''), chr(64980), '$') else t end as t from mk),
ll as (select file, string_split(case when suffix(t, {NL}) then left(t, length(t) - 1) else t end, {NL}) as l from ma where t <> ''),
ln as (select file, generate_subscripts(l, 1) as line, unnest(l) as s from ll),
bare as (select file, line, regexp_replace(s, '`[^`]*`', '', 'g') as s from ln),
cl as (select file, line, case when regexp_matches(s, '^{W}*[|#]') then '' else regexp_replace(regexp_replace(s, {raw(ASIDE)}, '', 'g'), '{W}+$', '') end as s from ln),
tr as (select file, line, regexp_replace(regexp_replace(s, '^{W}+', ''), '{W}+$', '') as x from cl),
bl as (select *, sum(case when x = '' then 1 else 0 end) over (partition by file order by line) as blk from tr),
p0 as (select file, line, blk, regexp_extract_all(x, '[^。！？]*[。！？]|[^。！？]+$') as ps from bl where x <> ''),
pc as (select file, line, blk, generate_subscripts(ps, 1) as k, unnest(ps) as p from p0),
pb as (select *, case when lag(regexp_matches(p, '[。！？]$')) over (partition by file, blk order by line, k) then 1 else 0 end as brk from pc),
pg as (select *, sum(brk) over (partition by file, blk order by line, k) as g from pb),
s0 as (select file, blk, g, min(line) as line, string_agg(p, '' order by line, k) as t from pg group by all),
s1 as (select file, blk, g, line, regexp_replace(regexp_replace(t, '^{W}+', ''), '{W}+$', '') as t from s0),
se as (select file, row_number() over (partition by file order by blk, g) as seq, line, t from s1 where t <> ''),
cs as (select file, string_agg(s, {NL} order by line) as c from cl group by file),
g0 as (select file, string_split(c, {NL} || {NL}) as gs from cs),
g1 as (select file, generate_subscripts(gs, 1) as k, unnest(gs) as p from g0),
g2 as (select *, 1 + coalesce(sum(length(p) - length(replace(p, {NL}, '')) + 2) over (partition by file order by k rows between unbounded preceding and 1 preceding), 0) + length(p) - length(ltrim(p, {NL})) as line,
   replace(p, {NL}, '') = '' as void, replace(p, {NL}, '') <> '' and len(list_filter(string_split(p, {NL}), lambda s: s <> '' and not regexp_matches(s, {raw(f'^{W}*{BULLET}')}))) = 0 as b from g1),
g3 as (select *, case when b and lag(b) over (partition by file order by k) then 0 else 1 end as brk, coalesce(lead(void) over (partition by file order by k), false) as gap from g2),
g4 as (select *, sum(brk) over (partition by file order by k) as u from g3),
un as (select file, row_number() over (partition by file order by min(k)) as seq, min(line) as line, string_agg(p, {NL} order by k) as t, max_by(b and not gap, k) as is_bullet from g4 where not void group by file, u)
"""


def listed(sql: str) -> str:
    return f"{PRELUDE} {sql}"


def row(value: str = "null", word: str = "null", line: str = "line") -> str:
    return f"select file, cast({line} as int) as line, round(cast({value} as double), 6) as value, cast({word} as varchar) as word"


def first(pattern: str) -> str:
    p = raw(pattern.replace(r"\p{IsHan}", r"\p{Han}").replace("(?:", "("))
    return f"{row(word=f'regexp_extract(t, {p})')} from se where regexp_matches(t, {p})"


def each(scope: str, pattern: str, groups: tuple[int, ...] = (0,)) -> str:
    """m: a row for each match in a scope of lines, with g0, g1 ..."""
    lists = ", ".join(f"unnest(regexp_extract_all(s, {raw(pattern)}, {g})) as g{i}" for i, g in enumerate(groups))
    return f", m as (select file, line, {lists} from {scope})"


def runs(flagged: str) -> str:
    """flagged: file, k, line, f, key. Runs of three or more of true flags with one key."""
    return f""", fl as ({flagged}), fb as (select *, case when f and lag(f) over w and key is not distinct from lag(key) over w then 0 else 1 end as brk from fl window w as (partition by file order by k)),
fi as (select *, sum(brk) over (partition by file order by k) as i from fb), ru as (select file, min(line) as line, count(*) as n, min(key) as key from fi where f group by file, i having count(*) >= 3)"""


TOKENS = r"list_filter(list_transform(list_filter(regexp_extract_all(t, '[a-zA-Z][a-zA-Z0-9_-]*'), lambda x: not regexp_matches(x, '[_0-9]') and not regexp_matches(x, '^[A-Z]{2,}$')), lambda x: lower(x)), lambda x: length(x) >= 2 and not regexp_matches(x, '^[ivx]+$'))"
DENSITY = f""", d as (select file, line, {TOKENS} as toks, len(regexp_extract_all(t, '{JA}')) as ja from un)
{row("len(toks) * 100.0 / ja", "array_to_string(list_sort(list_distinct(toks)), ' ')")} from d where ja >= 40"""
LATIN = f""", p as (select file, line, list_transform(regexp_extract_all(s, '[^\\s\\x{{3000}}]+|{W}+'), lambda t: case when (regexp_matches(t, '[0-9_/]') or (regexp_matches(t, '[A-Z]') and regexp_matches(t, '[a-z]')) or starts_with(lower(t), 'doi:')) and regexp_matches(t, '[A-Za-z]')
  then '。' else regexp_replace(t, '[a-z]+[A-Z-][A-Za-z-]*|[A-Z][A-Za-z-]*', '。', 'g') end) as ts from cl),
m as (select file, line, unnest(regexp_extract_all(array_to_string(ts, ''), '[a-z]{{2,}}(?:[ \\x{{3000}}]+[a-z]{{2,}})*')) as g from p)
{row("len(string_split(regexp_replace(g, '[ 　]+', ' ', 'g'), ' '))", "regexp_replace(g, '[ 　]+', ' ', 'g')")} from m"""
STYLE = f""", st as (select *, regexp_matches(t, {raw(POLITE)}) as po, regexp_matches(t, {raw(PLAIN_STYLE)}) as pl from se),
n as (select file, count(*) filter (po) as a, count(*) filter (pl and not po) as b from st group by file having count(*) filter (po) > 0 and count(*) filter (pl and not po) > 0),
f as (select st.file, line, least(a, b) as n, case when a <= b then 'polite' else 'plain' end as style, min(seq) as k from st join n on st.file = n.file where case when a <= b then po else pl and not po end group by all),
r as (select *, row_number() over (partition by file order by k) as i from f) {row("n", "style")} from r where i <= 5"""
OPENER = f"select file, seq as k, line, length(o) >= 2 and not regexp_matches(t, {raw(CONNECTOR)}) and not regexp_matches(t, '^[-*+・#]') as f, o as key from (select *, substring(regexp_extract(t, '^[^、。！？]*'), 1, 6) as o from se)"
NEAR = f""", u as (select file, seq, line, regexp_replace(t, '{W}+', '', 'g') as x from un where length(t) >= 40),
b0 as (select file, seq, line, x, unnest(range(1, length(x))) as i from u), bg as (select file, seq, substring(x, i, 2) as g, count(*) as n from b0 group by all),
nm as (select file, seq, cast(sum(n * n) as double) as norm from bg group by all),
dt as (select a.file, a.seq as a, b.seq as b, sum(a.n * b.n) as dot from bg a join bg b on a.file = b.file and a.g = b.g and a.seq < b.seq group by all)
select dt.file, cast(ub.line as int) as line, round(cast(dot as double) / sqrt(na.norm * nb.norm), 6) as value, cast(ua.line as varchar) as word from dt join nm na on na.file = dt.file and na.seq = a join nm nb on nb.file = dt.file and nb.seq = b
join u ua on ua.file = dt.file and ua.seq = a join u ub on ub.file = dt.file and ub.seq = b where 400.0::double * dot * dot >= 169.0::double * na.norm * nb.norm"""
UNENDED = f""", q0 as (select file, line, is_bullet, case when is_bullet then string_split(t, {NL}) else [t] end as ps from un), q1 as (select file, line + generate_subscripts(ps, 1) - 1 as line, unnest(ps) as p from q0),
q as (select file, line, regexp_replace(regexp_replace(p, '^{W}+', ''), '{W}+$', '') as s from q1), e as (select *, regexp_replace(s, '[*_` \t]+$', '') as x from q)
{row("length(s)", "right(s, 20)")} from e where length(s) >= 8 and x <> '' and not regexp_matches(x, {raw(TERMINATED)})"""
RHYTHM = f""", ml as (select file, generate_subscripts(l, 1) as line, unnest(l) as s from (select file, string_split(text, {NL}) as l from src)), mm as (select distinct file, line from ml where regexp_matches(s, {raw(f'^{W}*(?:>|{BULLET})')})),
a as (select se.* from se anti join mm on se.file = mm.file and se.line = mm.line where regexp_matches(t, '[。！？]$')),
sa as (select file, count(*) as n, avg(length(t)) as mu, stddev_pop(length(t)) as sd from a group by file),
b as (select file, length(t) - length(translate(t, '。！？', '')) as n from un where not is_bullet and not starts_with(regexp_replace(t, '^{W}+', ''), '>')), sb as (select file, count(*) as n, avg(n) as mu, stddev_pop(n) as sd from b where n >= 1 group by file)
select src.file, cast(coalesce(sa.n, 0) as int) as sentences, round(coalesce(sa.mu, 0), 6) as mean_chars, round(coalesce(sa.sd, 0), 6) as stdev_chars, round(coalesce((sa.sd - sa.mu) / (sa.sd + sa.mu), 0), 6) as burstiness,
cast(coalesce(sb.n, 0) as int) as paragraphs, round(coalesce(sb.mu, 0), 6) as para_mean_sentences, round(coalesce(sb.sd / sb.mu, 0), 6) as para_cv from src left join sa on sa.file = src.file left join sb on sb.file = src.file"""
STYLO = f""", ow as (select * from se where not starts_with(t, '>')), a as (select file, count(*) as n, count(*) filter (contains(t, 'ではなく')) as c, min(line) filter (contains(t, 'ではなく')) as fc, sum((length(t) - length(replace(t, '——', ''))) / 2) as dn from ow group by file),
h as (select file, count(*) filter (regexp_matches(s, '^#{{2,}} ')) as h, count(*) filter (regexp_matches(s, '^#{{2,}} .+ — ')) as g from ln group by file)
select src.file, cast(coalesce(n, 0) as int) as sentences, cast(coalesce(c, 0) as int) as contrast, cast(coalesce(fc, 1) as int) as first_contrast, cast(coalesce(dn, 0) as int) as dashes, cast(coalesce(h, 0) as int) as headings, cast(coalesce(g, 0) as int) as glossed,
cast(case when coalesce(n, 0) >= 30 then (case when c >= 6 and c * 100.0 >= 4.0 * n then 1 else 0 end) + (case when dn >= 5 and dn * 100.0 >= 4.0 * n then 1 else 0 end) + (case when h >= 6 and g >= 0.8 * h then 1 else 0 end) else 0 end as int) as fired
from src left join a on a.file = src.file left join h on h.file = src.file"""


def metaphors(stems: list[str]) -> str:
    table = ", ".join(f"({k}, '{s}')" for k, s in enumerate(stems))
    return f""", ow as (select file, line, regexp_replace(t, '「[^」]*」', '', 'g') as t from se where not starts_with(t, '>')), n as (select file, count(*) as n from ow group by file),
c as (select file, k, stem, sum((length(t) - length(replace(t, stem, ''))) / length(stem)) as n, min(line) as line from ow join (values {table}) v(k, stem) on contains(t, stem) group by all)
select c.file, cast(any_value(n.n) as int) as sentences, cast(sum(c.n) as int) as total, cast(min(line) as int) as line, string_agg(stem || '×' || cast(c.n as int), '・' order by c.n desc, k) as vocabulary from c join n on n.file = c.file group by c.file"""


def denied(terms: list[str]) -> str:
    return f"{row(word='term')} from bare join (values {', '.join(f'({raw(t)})' for t in terms)}) v(term) on contains(s, term)"


def jargon(terms: tuple[str, ...], practice: bool) -> str:
    table = ", ".join(f"({raw(t)})" for t in terms)
    ja = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
    hit = f""", f as (select file, term, min(line) as line from cl join (values {table}) v(term) on contains(s, term) and regexp_matches(s, '(?:^|[^A-Za-z0-9_])' || term || '(?:$|[^A-Za-z0-9_])') group by all),
j as (select f.*, substring(s, instr(s, term) + length(term)) as af, substring(s, 1, instr(s, term) - 1) as be from f join cl on cl.file = f.file and cl.line = f.line),
gl as (select distinct file, unnest(regexp_extract_all(string_split(s, '|')[2], '[a-zA-Z][a-zA-Z_-]*')) as term from (select file, unnest(string_split(text, {NL})) as s from src) where regexp_matches(s, '^\\s*\\|'))"""
    if not practice:
        return f"{hit} {row(word='term')} from j"
    return f"""{hit} {row(word='term')} from j anti join gl on gl.file = j.file and gl.term = j.term where not regexp_matches(af, '^ *（[^）]*{ja}') and not regexp_matches(af, '^ *\\([^)]*{ja}')
and not regexp_matches(be, '（[^（]*{ja}[^（]*） *$') and not regexp_matches(be, '\\([^(]*{ja}[^(]*\\) *$') and not contains(substring(af, 1, 6), 'とは')"""


def count_all(pattern: str, least: int) -> str:
    n = f"len(regexp_extract_all(t, '{pattern}'))"
    return f"{row(n)} from se where {n} >= {least}"


CHAINED = r"(?:[^\s\x{3000}。、！？の]{1,12}の){3,}"
CHAIN = f""", ch as (select file, line, regexp_extract(replace(regexp_replace(t, '『[^』]*』', '◯', 'g'), 'そのもの', '◯'), {raw(CHAINED)}) as c from se), cn as (select *, len(list_filter(string_split(c, 'の'), lambda x: x not in ('', 'こ', 'そ', 'あ', 'ど'))) as n from ch)
{row("n", "c")} from cn where c <> '' and n >= 3"""
NAKATEN = f""", m as (select file, line, unnest(list_concat(regexp_extract_all(s, '（([^（）]*)）', 1), regexp_extract_all(s, '\\(([^()]*)\\)', 1))) as g from cl), c as (select *, len(list_filter(string_split(g, '・'), lambda x: regexp_replace(x, '{W}+', '', 'g') <> '')) as n from m)
{row("n", "g")} from c where n >= 3"""
COLON = f""", nb as (select file, line, s from ln where regexp_replace(s, '{W}+', '', 'g') <> ''), nx as (select *, lead(s) over (partition by file order by line) as nxt from nb)
{row()} from nx where regexp_matches(regexp_replace(s, '{W}+$', ''), {raw(COLON_END)}) and regexp_matches(nxt, {raw(BLOCK)})"""
FIX = f""", fl as (select file, generate_subscripts(l, 1) as line, unnest(l) as s from (select file, string_split(text, {NL}) as l from src)), fm as (select *, starts_with(regexp_replace(s, '^{W}+', ''), '```') as m from fl),
fc as (select *, sum(m::int) over (partition by file order by line) as c from fm),
fx as (select file, line, s, case when m or c % 2 = 1 then s else array_to_string(list_transform(string_split(s, '`'), lambda x, i: case when i % 2 = 1 then replace(x, 'することができ', 'でき') else x end), '`') end as t from fc)
select file, string_agg(t, {NL} order by line) as text, cast(sum(length(s) - length(t)) / 5 as int) as n from fx group by file"""
SUPPRESSED = f""", mk0 as (select file, generate_subscripts(l, 1) as line, unnest(l) as s from (select file, string_split(text, {NL}) as l from src)),
mk1 as (select file, line, list_filter(regexp_split_to_array(trim(regexp_replace(trim(string_split(s, 'prose-ignore')[2]), '(?:-->)+$', '')), '[ ,:]'), lambda x: x <> '') as names from mk0 where contains(s, 'prose-ignore')),
mk2 as (select file, line, unnest(case when len(names) > 0 then names else [null] end) as name from mk1), sp as (select file, line, name from mk2 union select file, line + 1, name from mk2),
x as (select file, line, regexp_extract(t, '[！!]') as w from se where regexp_matches(t, '[！!]'))
{row(word='w')} from x anti join sp on sp.file = x.file and sp.line = x.line and (sp.name is null or sp.name in ('readability', 'exclamation'))"""
COUNTED = f"{each('cl', COUNTER, (1, 2, 3))} {row('g1', 'g2')} from m where coalesce(g0, '') = '' and g2 not in ({', '.join(map(raw, UNITS))})"


def queries(stems: list[str], terms: tuple[str, ...], own: str) -> dict[str, str]:
    rest = {
        "lines_clean": "select file, cast(line as int) as line, s as text from cl",
        "sentences": "select file, cast(line as int) as line, cast(seq as int) as seq, t as text from se",
        "units": "select file, cast(line as int) as line, cast(seq as int) as seq, t as text, is_bullet from un",
        "sentence_length": f"{row('length(t)')} from se where length(t) > 100",
        "max_ten": f"""{row("length(t) - length(replace(t, '、', ''))")} from se where length(t) - length(replace(t, '、', '')) > 4""",
        "double_negative": first(DOUBLE_NEGATIVE),
        "hedge_pileup": count_all(HEDGE, 2),
        "demonstrative_chain": count_all(DEMONSTRATIVE, 3),
        "no_chain": CHAIN,
        "verbose_potential": first("することが(?:でき|可能)"),
        "kanji_run": first(r"[\p{IsHan}々]{7,}"),
        "exclamation": first("[！!]"),
        "style_mixing": STYLE,
        "bullet_template": runs(f"select file, line as k, line, regexp_matches(s, {raw(TEMPLATE)}) as f, '' as key from ln") + f" {row('n')} from ru",
        "colon_continuation": COLON,
        "connector_pileup": runs(f"select file, seq as k, line, regexp_matches(t, {raw(CONNECTOR)}) as f, '' as key from se") + f" {row('n')} from ru",
        "opener_repetition": runs(OPENER) + f" {row('n', 'key')} from ru",
        "latin_density": DENSITY + " and len(toks) * 100.0 / ja >= 8.0",
        "latin_density_all_units": DENSITY,
        "latin_token_runs": LATIN,
        "verb_calque": f"{each('bare', CALQUE, (1, 2))} {row(word='g0 || g1')} from m",
        "near_duplicate": NEAR,
        "rhythm_stats": RHYTHM,
        "stylometric_indicators": STYLO,
        "metaphor_counts": metaphors(stems),
        "arrow": f"{each('cl', '[→⇒⟹]')} {row(word='g0')} from m",
        "fullwidth_eq": f"{each('cl', f'{JA}＝|＝{JA}')} {row(word='g0')} from m",
        "paren_nakaten": NAKATEN,
        "unterminated_prose": UNENDED,
        "missing_counter": COUNTED,
        "denied_terms": denied([own]),
        "slop_phrases": denied(DENIED),
        "jargon_practice": jargon(terms, True),
        "jargon_consume": jargon(terms, False),
        "suppressed_exclamation": SUPPRESSED,
        "autofix": FIX,
    }
    out = {k: listed(v) for k, v in rest.items()}
    out["flat_rhythm"] = f"select file, cast(1 as int) as line, burstiness as value, cast(null as varchar) as word from ({listed(RHYTHM)}) where sentences >= 30 and burstiness < -0.40"
    out["uniform_paragraphs"] = f"select file, cast(1 as int) as line, para_cv as value, cast(null as varchar) as word from ({listed(RHYTHM)}) where paragraphs >= 6 and para_mean_sentences between 2 and 6 and para_cv < 0.26"
    out["stylometric_uniformity"] = f"select file, first_contrast as line, cast(fired as double) as value, cast(null as varchar) as word from ({listed(STYLO)}) where fired >= 2"
    out["metaphor_density"] = f"select file, line, round(total * 100.0 / sentences, 6) as value, vocabulary as word from ({listed(metaphors(stems))}) where sentences >= 30 and total >= 3 and total * 100.0 / sentences >= 2.0"
    return out
