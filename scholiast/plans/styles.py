"""Queries of writing style: audits, markers, connectives, openers, frames and briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.functions import text as T
from scholiast.operators import style as S
from scholiast.operators.frames import frames_of, match_frames
from scholiast.plans.registry import query, table
from scholiast.plans.texts import AUDIT_PARAGRAPHS, AUDIT_SENTENCES, BOUNDED, OTHER_LETTERS, sentence_list

# a text of every third document says what an audit looks for
_SAID = "CASE doc_id % 3 WHEN 0 THEN text || ' However, studies show that we may utilize it, highlighting the robust and novel realm [3]. It was often used; this is not just a test but a myriad. In recent years Fig. 2 suggests more. ' || text ELSE text END"
SAID = f"said AS (SELECT doc_id, source, {_SAID} AS text FROM documents)"


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(_SAID).alias("text"))


# an engine with ASCII word boundaries sees letters of other alphabets as an underscore
_ASCII = f"regexp_replace(text, '[{OTHER_LETTERS}]', '_', 'g')"


def _sizes(x: str) -> str:
    return rf"list_transform({x}, lambda x: len(regexp_extract_all(x, '\S+')))"


def _cut(cut: int, parts: int, s: str = "s") -> str:
    """SQL of an exclusive quantile of more than one ascending value."""
    h = f"({cut} * (len({s}) + 1) / {parts}.0)"
    j = f"greatest(1, least(floor({h})::BIGINT, len({s}) - 1))"
    return f"CASE WHEN len({s}) = 1 THEN {s}[1]::DOUBLE ELSE round({s}[{j}] + ({h} - {j}) * ({s}[{j} + 1] - {s}[{j}]), 6) END"


AUDITED = f"""a AS (SELECT *, {BOUNDED} AS words, {_sizes(AUDIT_SENTENCES)} AS l0, list_sort({_sizes(AUDIT_PARAGRAPHS)}) AS p FROM said), b AS (SELECT *, CASE WHEN len(l0) = 0 THEN [0] ELSE list_sort(l0) END AS s, coalesce(l0[1], 0) AS f FROM a),
audited AS (SELECT doc_id, source, words, len(l0) AS sentences, len(p) AS paragraphs, round_even({_cut(1, 2)}, 0)::INT AS median, round_even(CASE WHEN len(s) > 3 THEN {_cut(1, 4)} ELSE f END, 0)::INT AS p25, round_even(CASE WHEN len(s) > 3 THEN {_cut(3, 4)} ELSE f END, 0)::INT AS p75, round_even(CASE WHEN len(s) > 9 THEN {_cut(9, 10)} ELSE s[-1] END, 0)::INT AS p90,
 round_even(100 * len(list_filter(s, lambda x: x < 15)) / len(s), 0)::INT AS pct_under_15, round_even(100 * len(list_filter(s, lambda x: x > 30)) / len(s), 0)::INT AS pct_over_30, CASE WHEN len(p) > 0 THEN round_even({_cut(1, 2, 'p')}, 0)::INT ELSE 0 END AS paragraph_median, coalesce(p[-1], 0) AS paragraph_max, len(list_filter(p, lambda x: x > 180)) AS over_180 FROM b)"""


@query(f"WITH {SAID}, {AUDITED} SELECT * EXCLUDE (source) FROM audited WHERE words >= 80")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-01, STR-26: sentence and paragraph statistics"""
    return S.audit(said(spark, sf_dir), "doc_id", "text")


@query(f"""WITH {SAID}, {AUDITED}, w AS (SELECT source, sum(words)::BIGINT AS words, sum(sentences)::BIGINT AS sentences, sum(paragraphs)::BIGINT AS paragraphs FROM audited GROUP BY 1), m AS (SELECT source, median(x) AS median FROM (SELECT source, unnest(l0) AS x FROM a) GROUP BY 1)
SELECT source, doc_id, words, sentences, paragraphs, median::DOUBLE AS median FROM audited WHERE words >= 80 UNION ALL SELECT source, NULL, words, sentences, paragraphs, median FROM w LEFT JOIN m USING (source)""")
def project_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-08: every file of a project, and all of them together"""
    return S.project_audit(said(spark, sf_dir), "source", "doc_id", "text")


_SECTION = "CASE doc_id % 7 WHEN 0 THEN 'intro' WHEN 1 THEN 'methods' WHEN 2 THEN 'results' WHEN 3 THEN 'discussion' WHEN 4 THEN 'conclusion' WHEN 5 THEN 'abstract' ELSE 'annex' END"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _number(x: float | None) -> str:
    return "NULL" if x is None else str(float(x))


_ROWS = ", ".join([f"('text', NULL, {_quoted(a)}, {_quoted('(?i)' + b)}, {_number(c)}, {_number(d)})" for a, b, c, d in S.MARKERS] + [f"('section', '{name}', {_quoted(a)}, {_quoted('(?i)' + S.EXTRA[a])}, {_number(b[0])}, {_number(b[1])})" for name, targets in S.SECTION_TARGETS.items() for a, b in targets.items()])


@query(f"""WITH {SAID}, m AS (SELECT * FROM (VALUES {_ROWS}) m(part, section, label, pattern, low, high)), d AS (SELECT doc_id, text, {_SECTION} AS own, {BOUNDED} AS words FROM said), c AS (SELECT doc_id, part, label, len(regexp_extract_all({_ASCII}, pattern)) AS n, words, low, high FROM d JOIN m ON words >= 80 AND (section IS NULL OR section = own))
SELECT doc_id, CASE part WHEN 'text' THEN 'text' ELSE (SELECT any_value({_SECTION}) FROM (SELECT c.doc_id AS doc_id)) END AS part, label, n, round(1000 * n / words, 2) AS rate, CASE WHEN low IS NOT NULL AND round(1000 * n / words, 2) < low THEN 'low' WHEN high IS NOT NULL AND round(1000 * n / words, 2) > high THEN 'high' ELSE 'ok' END AS verdict FROM c""".replace(f"CASE part WHEN 'text' THEN 'text' ELSE (SELECT any_value({_SECTION}) FROM (SELECT c.doc_id AS doc_id)) END AS part", f"CASE part WHEN 'text' THEN 'text' ELSE {_SECTION} END AS part"))
def audit_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-01, MTH-06: twenty-one markers and the targets of a text's section, with their verdicts"""
    return S.audit_markers(said(spark, sf_dir).withColumn("section", F.expr(_SECTION)), "doc_id", "text", "section")


_HARD = " UNION ALL ".join(f"SELECT doc_id, {_quoted(kind)} AS kind, regexp_extract_all(text, {_quoted('(?i)' + pattern)}) AS m, string_split_regex(text, {_quoted('(?i)' + pattern)}) AS g, text FROM d" for kind, pattern in S.HARD)


@query(f"""WITH {SAID}, d AS (SELECT doc_id, text FROM said WHERE {BOUNDED} >= 80), f AS ({_HARD}), u AS (SELECT doc_id, kind, text, m, g, unnest(range(len(m))) AS n FROM f),
p AS (SELECT doc_id, kind, n, m[n + 1] AS match, text, (list_sum(list_transform(g[1 : n + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : n], lambda x: length(x))), 0))::BIGINT AS a FROM u)
SELECT doc_id, kind, n::INT AS n, match, trim(regexp_replace(substr(text, greatest(0, a - 45) + 1, a - greatest(0, a - 45) + length(match) + 45), '\\s+', ' ', 'g')) AS context FROM p""")
def hard_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-01: what a draft must not say, in its context"""
    return S.hard_flags(said(spark, sf_dir), "doc_id", "text")


_BUDGET = [("However / Yet", 1.2), ("em dash —", 0.15), ("semicolon", 1.1), ("the / of / and", 20.0), ("la / de / que", 15.0)]
_CONNECT = ", ".join(f"({_quoted(a)}, {_quoted(S.marker_pattern(a))}, {r})" for a, r in _BUDGET)


@query(f"""WITH {SAID}, b AS (SELECT * FROM (VALUES {_CONNECT}) b(marker, pattern, corpus)), d AS (SELECT doc_id, text, greatest(len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*')), 1) AS words FROM said), c AS (SELECT doc_id, marker, corpus::DOUBLE AS corpus, len(regexp_extract_all({_ASCII}, pattern)) AS n, words FROM d, b)
SELECT doc_id, marker, n, round(1000 * n / words, 2) AS rate, corpus, CASE WHEN n >= 2 AND round(1000 * n / words, 2) > greatest(2 * corpus, 0.3) THEN 'over' WHEN n > 0 THEN 'ok' ELSE 'unused' END AS status FROM c""")
def connectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-03: uses of connectives against the corpus"""
    return S.connectives(said(spark, sf_dir), "doc_id", "text", _BUDGET)


_STOP = ", ".join(f"'{w}'" for w in [*S.STOP_OPENERS, ","])


@query(f"""WITH {SAID}, t AS (SELECT doc_id, unnest({sentence_list(4)}) AS s, generate_subscripts({sentence_list(4)}, 1) AS i FROM said), w AS (SELECT doc_id, i, s, regexp_extract_all(s, '[A-Za-z][A-Za-z''\\-]*|,')[1:3] AS w FROM t), k AS (SELECT *, replace(array_to_string(w, ' '), ' ,', ',') AS k FROM w WHERE len(w) = 3 AND len(list_filter(w, lambda x: lower(x) NOT IN ({_STOP}))) > 0)
SELECT arg_min(k, doc_id * 100000 + i) AS opener, count(*) AS n, arg_min(s, doc_id * 100000 + i) AS example, arg_min(doc_id, doc_id * 100000 + i) AS sample FROM k GROUP BY lower(k) HAVING count(*) >= 2 ORDER BY n DESC, min(doc_id * 100000 + i) LIMIT 40""")
def openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-04: openers that recur, with the first example"""
    t = said(spark, sf_dir).select("doc_id", F.posexplode(T.sentences("text")).alias("i", "s"))
    return S.openers(t, "s", ["doc_id", "i"], "doc_id")


FRAMES = ["However, X show/shows that Y.", "X suggests Y.", "the X of the Y", "It was Z used; N", "Two A have been made. In the first, B", "in recent years X"]
_COMPILED = frames_of(tuple(FRAMES))
_TRIED = " ".join(f"WHEN regexp_matches(s, {_quoted(f.regex)}) THEN {i}" for i, f in enumerate(_COMPILED))
_NAMES = " ".join(f"WHEN {i} THEN {_quoted(f.text)}" for i, f in enumerate(_COMPILED))
_PIECES = " ".join(f"WHEN {i} THEN [" + ", ".join(f"'{'S' if k in (0, len(f.pieces) + 1) or k % 2 == 0 else 'L'}:' || regexp_extract(s, {_quoted(f.regex)}, {k + 1})" for k in range(len(f.pieces) + 2)) + "]" for i, f in enumerate(_COMPILED))
MATCHED = f"""sent AS (SELECT DISTINCT doc_id, unnest({sentence_list(4)}) AS s FROM said), tried AS (SELECT *, CASE {_TRIED} END AS k FROM sent), matched AS (SELECT doc_id, s, CASE k {_NAMES} END AS frame, list_filter(CASE k {_PIECES} END, lambda x: length(x) > 2) AS parts FROM tried WHERE k IS NOT NULL)"""


@query(f"WITH {SAID}, {MATCHED} SELECT doc_id, s AS sentence, frame, array_to_string(parts, '|') AS parts FROM matched")
def frame_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-02: frames with slots and alternatives against every sentence, which is cut into the frame's words and the slots"""
    t = said(spark, sf_dir).select("doc_id", F.explode(T.sentences("text")).alias("sentence"))
    shown = F.array_join(F.transform("parts", lambda x: F.concat(F.when(x["slot"], "S:").otherwise("L:"), x["text"])), "|")
    return match_frames(t, "doc_id", "sentence", FRAMES).select("doc_id", "sentence", "frame", shown.alias("parts"))


_ID = r"left(sha1(trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))), 12)"


@query(f"""WITH {SAID}, {MATCHED}, h AS (SELECT DISTINCT {_ID.format('s')} AS id FROM matched WHERE doc_id % 2 = 0), n AS (SELECT doc_id, count(*) AS sentences FROM (SELECT doc_id, unnest({sentence_list(4)}) AS s FROM said) GROUP BY 1), a AS (SELECT doc_id, unnest({sentence_list(4)}) AS s FROM said)
SELECT n.doc_id, sentences, coalesce(matched, 0) AS matched FROM n LEFT JOIN (SELECT a.doc_id, count(*) AS matched FROM a JOIN matched m ON m.doc_id = a.doc_id AND m.s = a.s WHERE {_ID.format('a.s')} NOT IN (SELECT id FROM h) GROUP BY 1) USING (doc_id)""")
def style_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-05: sentences of each sample that match a frame and are not hidden"""
    t = said(spark, sf_dir).select("doc_id", F.explode(T.sentences("text")).alias("sentence"))
    hidden = match_frames(t, "doc_id", "sentence", FRAMES).filter("doc_id % 2 = 0").select(S.sentence_id("sentence").alias("id")).distinct()
    return S.bank(t, "doc_id", "sentence", FRAMES, hidden)


@query("SELECT source, sha1('v3:pack' || string_agg(doc_id || ':' || (n_chars * 7) || ':' || n_chars || ';', '' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source")
def bank_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-05: what tells whether a bank must be built again"""
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("name"), (F.col("n_chars") * 7).alias("modified"), F.col("n_chars").alias("size"))
    return S.bank_fingerprint(d, "source", "v3:pack")


_BANK = "'## 0. About' || chr(10) || '### None' || chr(10) || '`hidden X`' || chr(10) || '## 1. General' || chr(10) || 'note' || chr(10) || '### Claim ' || turn || chr(10) || '`X shows Y` and `ab`' || chr(10) || 'see `not here`' || chr(10) || '> \"Said ' || conv_id || '\" — Roe' || chr(10) || '### Doubt' || chr(10) || '## 2. Results' || chr(10) || '- bullet' || chr(10) || '### Trend' || chr(10) || '`X rose` `Y fell to Z`' || chr(10) || '> \"More\"'"


@query("""SELECT conv_id * 1000 + turn AS id, '1. General' AS section, 'Claim ' || turn AS move, 'X shows Y' AS patterns, 'Said ' || conv_id AS exemplars FROM conversations UNION ALL SELECT conv_id * 1000 + turn, '1. General', 'Doubt', '', '' FROM conversations UNION ALL SELECT conv_id * 1000 + turn, '2. Results', 'Trend', 'X rose|Y fell to Z', 'More' FROM conversations""")
def phrase_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-06: moves of a phrase bank with patterns and exemplars"""
    md = F.expr(_BANK.replace("chr(10)", "'\\n'"))
    lines = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.posexplode(F.split(md, "\n")).alias("n", "line"))
    return S.phrase_cards(lines, "id", "n", "line").select("id", "section", "move", F.array_join("patterns", "|").alias("patterns"), F.array_join("exemplars", "|").alias("exemplars"))


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, '## ' || role || chr(10) || chr(10) || trim(text) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE trim(text) <> ''), r AS (SELECT conv_id, 0::BIGINT AS n, 100::BIGINT AS used, ''::VARCHAR AS out FROM (SELECT DISTINCT conv_id FROM s)
UNION ALL SELECT s.conv_id, s.n, CASE WHEN used + length(b) <= 900 THEN used + length(b) + 2 ELSE used END, CASE WHEN used + length(b) <= 900 THEN out || CASE WHEN out = '' THEN '' ELSE chr(10) || chr(10) END || b ELSE out END FROM r JOIN s ON s.conv_id = r.conv_id AND s.n = r.n + 1)
SELECT conv_id, arg_max(out, n) AS text FROM r GROUP BY conv_id HAVING arg_max(out, n) <> ''""")
def section_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-07: slices in order of priority, those over the budget skipped"""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), F.col("role").alias("title"), "text")
    return S.brief(c, "conv_id", 900, 100)


@query("""WITH RECURSIVE m AS (SELECT conv_id, turn % 2 = 0 AS general, turn AS place, '- **m' || turn || '** — e.g. "' || left(text, 120) || '" / "' || role || '"' AS l FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY general, place) AS n FROM m), r AS (SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS used, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM m)
UNION ALL SELECT o.conv_id, o.n, CASE WHEN used + length(l) <= 400 THEN used + length(l) ELSE used END, CASE WHEN used + length(l) <= 400 THEN list_append(lines, l) ELSE lines END FROM r JOIN o ON o.conv_id = r.conv_id AND o.n = r.n + 1),
k AS (SELECT conv_id, arg_max(lines, n) AS lines FROM r GROUP BY 1), v AS (SELECT conv_id, string_agg('w' || turn || ' (2.5/1k vs 1.0)', ', ' ORDER BY turn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn % 2 = 1) WHERE n <= 6 GROUP BY 1)
SELECT conv_id, array_to_string(CASE WHEN t IS NULL THEN lines ELSE list_append(lines, '- Over-used: ' || t) END, chr(10)) AS text FROM k LEFT JOIN v USING (conv_id) WHERE len(lines) > 0 OR t IS NOT NULL""")
def personal_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-09: moves of the section first, two examples each, within a budget, then connectives that are over-used"""
    c = table(spark, sf_dir, "conversations")
    moves = c.select("conv_id", (F.col("turn") % 2 == 0).alias("general"), F.col("turn").alias("place"), F.concat(F.lit("m"), "turn").alias("move"), F.array(F.left("text", F.lit(120)), "role", F.lit("third")).alias("examples"))
    over = c.filter("turn % 2 = 1").select("conv_id", F.col("turn").alias("place"), F.concat(F.lit("w"), "turn").alias("marker"), F.lit(2.5).alias("rate"), F.lit(1.0).alias("corpus"))
    return S.personal_slice(moves, "conv_id", over, budget=400).select("conv_id", F.array_join("lines", "\n").alias("text")).filter("text <> ''")


@query("SELECT o_orderkey::VARCHAR AS section, o_orderstatus AS move, CASE WHEN o_orderkey % 3 = 0 THEN 'mine ' || o_orderkey || '|' ELSE '' END || o_orderpriority || '|' || o_custkey AS exemplars FROM orders")
def exemplars_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STY-10: a writer's own sentences first, two of the corpus behind"""
    o = table(spark, sf_dir, "orders")
    key = [F.col("o_orderkey").cast("string").alias("section"), F.col("o_orderstatus").alias("move")]
    cards = o.select(*key, F.array("o_orderpriority", F.col("o_custkey").cast("string"), F.lit("third")).alias("exemplars"))
    mine = o.filter("o_orderkey % 3 = 0").select(*key, F.array(F.concat(F.lit("mine "), "o_orderkey")).alias("exemplars"))
    return S.merged_exemplars(cards, mine).select("section", "move", F.array_join("exemplars", "|").alias("exemplars"))
