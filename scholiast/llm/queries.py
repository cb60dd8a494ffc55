"""The registered queries of this package; each applies one operator to its whole table."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.llm.ann import nearest
from scholiast.llm.chat import format_chats
from scholiast.llm.collocations import collocations
from scholiast.llm.decontaminate import contaminated
from scholiast.llm.html_text import main_text
from scholiast.llm.line_dedup import dedup_lines
from scholiast.llm.lm_score import lm_scores
from scholiast.llm.mixing import mix_sources
from scholiast.llm.near_dedup import near_duplicates
from scholiast.llm.quality import score_quality, train
from scholiast.llm.substring_dedup import repeated_passages
from scholiast.llm.token_files import read_ids
from scholiast.llm.token_ids import write_token_ids
from scholiast.llm.word_runs import word_runs
from scholiast.operators.graph import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, _table(spark, sf_dir, "labels")))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes token files into a new folder of the shared one, where they stay as the operator's output, and reads them back."""
    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32 of the decimal doc_id, texts whose h % 10 is 0 repeat, from word g % n on (g = h // 10), a stretch of 1 + (n - g % n) // (3 + g % 8) words to their end. A null doc_id has no number and its text stays."""

    def changed(doc_id: int | None, text: str | None) -> str | None:
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 or not (words := (text or "").encode().split()):  # bytes split at 0x20 and 0x09-0x0D
            return text
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = map(changed, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string")


def run_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the runs of words of each row."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = word_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.selectExpr("doc_id", "n_runs", "-best.start AS start", "best.length AS length", "-best.period AS period", "1000 * best.length div -best.period AS exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(_with_periods(_table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quality": op2_quality,
    "op3_lm_scores": op3_lm_scores,
    "op4_chat_format": op4_chat_format,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_nearest": op8_nearest,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_html_text": op10_html_text,
    "op11_token_ids": op11_token_ids,
    "op12_word_runs": op12_word_runs,
    "op13_collocations": op13_collocations,
}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

# Columns that SQL can give for all rows; the other operators have brute-force versions in the tests.
ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i : i + 4], chr(10)) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, t.b FROM reach r JOIN ways t ON r.b = t.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON a = doc_id""",
    "op6_line_dedup": f"""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
l AS (SELECT doc_id, i, line, {_WORDS.format("line")} AS w FROM raw),
d AS (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, min(doc_id * 10000000 + i) AS place FROM l WHERE len(w) > 0 GROUP BY k),
v AS (SELECT place, pos, array_to_string(list_concat(w[: pos - 1], w[pos + 1 :]), ' ') AS x FROM (SELECT place, w, unnest(range(1, len(w) + 1)) AS pos FROM d WHERE len(w) >= 10)),
gone AS (SELECT b.place FROM v a JOIN v b ON a.x = b.x AND a.pos = b.pos AND a.place < b.place UNION SELECT greatest(d.place, v.place) FROM d JOIN v ON d.k = v.x WHERE len(d.w) >= 10),
kept AS (SELECT place FROM d WHERE place NOT IN (SELECT place FROM gone)),
m AS (SELECT l.*, len(w) > 0 AS full_line, place IS NOT NULL AS stays FROM l LEFT JOIN kept ON place = doc_id * 10000000 + i)
SELECT doc_id, count(*) FILTER (full_line)::INT AS n_lines, count(*) FILTER (full_line AND stays)::INT AS n_kept, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT full_line OR stays), '') AS text FROM m GROUP BY doc_id""",
    "op13_collocations": """WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS t FROM documents),
p AS (SELECT d, lang, unnest(t) AS t, generate_subscripts(t, 1) AS p FROM d),
w AS (SELECT d, lang, p, unnest(string_split_regex(t, '[ \x09]+')) AS w, generate_subscripts(string_split_regex(t, '[ \x09]+'), 1) AS i FROM p),
x AS (SELECT lang, w AS w1, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM (FROM w WHERE w <> '') WINDOW s AS (PARTITION BY d, p ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS a FROM x GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS a FROM x WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM x WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f1 GROUP BY lang),
longer AS (SELECT lang, w1, w2, max(a) AS most FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
cuts AS (SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.a, h.a AS l, t.a AS r FROM f2 c JOIN f1 h ON h.lang = c.lang AND h.w1 = c.w1 JOIN f1 t ON t.lang = c.lang AND t.w1 = c.w2 LEFT JOIN longer o ON o.lang = c.lang AND o.w1 = c.w1 AND o.w2 = c.w2 WHERE o.most IS NULL OR 100 * o.most < 50 * c.a
UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.a, h.a, t.a FROM f3 c JOIN f1 h ON h.lang = c.lang AND h.w1 = c.w1 JOIN f2 t ON t.lang = c.lang AND t.w1 = c.w2 AND t.w2 = c.w3
UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.a, h.a, t.a FROM f3 c JOIN f2 h ON h.lang = c.lang AND h.w1 = c.w1 AND h.w2 = c.w2 JOIN f1 t ON t.lang = c.lang AND t.w1 = c.w3),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}
