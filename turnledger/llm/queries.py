"""Queries of the corpus operators, and the SQL they must equal where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnledger.llm.crosssplit import coverage, cross_split_counts, cross_split_pairs, prompts_of
from turnledger.llm.encoding import encode_texts
from turnledger.llm.leakage import MASKS, leaked_passages
from turnledger.llm.mojibake import garbled_texts
from turnledger.llm.packing import length_buckets, pack, pieces_of
from turnledger.llm.spans import shared_spans
from turnledger.session import table


def _generations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "trace").where(F.col("record_type") == "generation").select("trace_id", "sequence", "session_id", "input_ids", "output_ids")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(_generations(spark, folder), ids=["trace_id", "sequence"], owner="session_id", arrays=["input_ids", "output_ids"])


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per record and array: tokens, shared tokens and stretches, and the share; 0 where nothing is shared, null for the
    share of an empty array. Arrays that are null have no row."""
    sizes = F.array(*(F.struct(F.lit(c).alias("array_name"), F.size(c).alias("n_tokens")) for c in ("input_ids", "output_ids")))
    rows = _generations(spark, folder).select("trace_id", "sequence", F.explode(sizes).alias("z")).select("trace_id", "sequence", "z.array_name", "z.n_tokens")
    lengths = rows.where(F.col("n_tokens") >= 0).groupBy("trace_id", "sequence", "array_name").agg(F.max("n_tokens").alias("n_tokens"))
    found = p2_found(spark, folder).groupBy("trace_id", "sequence", "array_name").agg(
        F.sum(F.col("span_end") - F.col("span_start")).alias("shared"), F.count("*").alias("n")
    )
    on = F.lit(True)
    for c in ("trace_id", "sequence", "array_name"):
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    none = lambda c: F.coalesce(c, F.lit(0))
    return lengths.alias("a").join(found.alias("b"), on, "left").select(
        "a.trace_id", "a.sequence", "a.array_name", "n_tokens", none("b.shared").alias("shared_tokens"), none("b.n").alias("n_spans"),
        F.when(F.col("n_tokens") > 0, none("b.shared") / F.col("n_tokens")).alias("share"),
    )


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """Each usable feature once, with its run's width: input_ids not empty, labels of their length, a run with a width."""
    rows = table(spark, folder, "features").where((F.size("input_ids") > 0) & (F.size("labels") == F.size("input_ids")))
    once = rows.groupBy("feature_id").agg(F.min(F.struct("run_id", F.size("input_ids").alias("size"))).alias("f"))
    widths = table(spark, folder, "run_result").groupBy("run_id").agg(F.max("width").alias("capacity")).where(F.col("capacity") > 0)
    items = once.select(F.col("f.run_id").alias("run_id"), F.col("feature_id").alias("item"), "f.size").join(widths, "run_id")
    return items.withColumnRenamed("run_id", "group")


def p3_containers(spark: SparkSession, folder: str) -> DataFrame:
    names = {"group": "run_id", "item": "feature_id", "start": "piece_start", "length": "piece_length"}
    return pack(_items(spark, folder)).withColumnsRenamed(names)


def p3_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per run: containers, tokens, pieces and the share of the containers' space that is used."""
    width = _items(spark, folder).select(F.col("group").alias("run_id"), "capacity").distinct()
    by_run = p3_containers(spark, folder).groupBy("run_id").agg(
        (F.max("container") + 1).alias("n_containers"), F.sum("piece_length").alias("n_tokens"), F.count("*").alias("n_pieces")
    )
    return by_run.join(width, "run_id").withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))


def p3_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per run what must hold of any packing: all pieces and tokens are there, none overlap or reach beyond the width, none is
    cut that fits, no container number is left out."""
    width = _items(spark, folder).select(F.col("group").alias("run_id"), F.col("item").alias("feature_id"), "size", "capacity")
    placed = p3_containers(spark, folder).join(width, ["run_id", "feature_id"])
    # a container is bounded by its width
    before = F.lag(F.col("offset") + F.col("piece_length")).over(Window.partitionBy("run_id", "container").orderBy("offset"))
    rows = placed.withColumn("before", before)
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    by_container = rows.groupBy("run_id", "container").agg(
        F.count("*").alias("n"), F.sum("piece_length").alias("tokens"), bad(F.col("offset") < F.col("before")).alias("overlaps"), bad(F.col("offset") + F.col("piece_length") > F.col("capacity")).alias("beyond"),
        bad((F.col("size") <= F.col("capacity")) & (F.col("piece_length") < F.col("size"))).alias("cuts"), bad(F.col("piece_start") == 0).alias("features"),
    )
    total = {"n_pieces": "n", "n_tokens": "tokens", "n_features": "features", "n_overlaps": "overlaps", "n_beyond": "beyond", "n_needless_cuts": "cuts"}
    return by_container.groupBy("run_id").agg(*(F.sum(c).alias(n) for n, c in total.items()), (F.max("container") + 1 - F.count("*")).alias("n_missing_containers"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces that must be placed, per run: their number, tokens and longest."""
    return pieces_of(_items(spark, folder)).groupBy(F.col("group").alias("run_id")).agg(
        F.count("*").alias("n_pieces"), F.sum("length").alias("n_tokens"), F.max("length").alias("longest")
    )


def p3_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve length buckets that pad all pieces least."""
    counts = sorted((r["length"], r["count"]) for r in pieces_of(_items(spark, folder)).groupBy("length").count().collect())
    bounds, _ = length_buckets([x for x, _ in counts], [n for _, n in counts], 12)
    rows = [(i, b, sum(n for x, n in counts if (bounds[i - 1] if i else 0) < x <= b), sum((b - x) * n for x, n in counts if (bounds[i - 1] if i else 0) < x <= b)) for i, b in enumerate(bounds)]
    return spark.createDataFrame(rows, "bucket int, upper_length bigint, n_pieces bigint, padding bigint")


_SAMPLE = {"index": "index", "split": "split", "tokens": "tokens", "response_length": "response_length"}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cross_split_pairs(table(spark, folder, "rollout_samples"), **_SAMPLE)
    return pairs.select(F.least("held", "train").alias("index_a"), F.greatest("held", "train").alias("index_b")).distinct()


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out samples with a training counterpart, and such pairs, per split and source."""
    return cross_split_counts(table(spark, folder, "rollout_samples"), by=("split", "source"), **_SAMPLE)


def p5_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per held-out sample: prompt tokens, those in spans of 8 or more tokens that a training prompt has too, and the
    longest such span, rounded down to 4, 8, 16, ... (0 for none)."""
    prompts = prompts_of(table(spark, folder, "rollout_samples"), held_out=("eval", "test"), train="train", **_SAMPLE)
    return prompts.where(~F.col("side")).select("index", "key").distinct().join(coverage(prompts), "key").select("index", "n_tokens", "covered", "longest").distinct()


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents").select("doc_id", "text"), text="text")


def _leaks(spark: SparkSession, folder: str, **how) -> DataFrame:
    return leaked_passages(
        table(spark, folder, "documents"), table(spark, folder, "eval_items"), document_id="doc_id", document_text="text", item_id="item_id", item_text="text", **how
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder, masks=MASKS).where(F.col("exact_words") >= 12).select(F.col("document").alias("doc_id"), F.col("item").alias("item_id"))


def p7_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).withColumnsRenamed({"document": "doc_id", "item": "item_id"})


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_texts(table(spark, folder, "documents"), key="doc_id", text="text").select(F.col("key").alias("doc_id"))


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_texts(table(spark, folder, "documents"), key="doc_id", text="text").withColumnRenamed("key", "doc_id")


QUERIES = {"p2_found": p2_found, "p2_shares": p2_shares, "p3_containers": p3_containers, "p3_fill": p3_fill, "p3_checks": p3_checks, "p3_pieces": p3_pieces, "p3_buckets": p3_buckets, "p5_found": p5_found, "p5_counts": p5_counts, "p5_coverage": p5_coverage, "p6_ids": p6_ids, "p7_found": p7_found, "p7_overlaps": p7_overlaps, "p8_found": p8_found, "p8_restored": p8_restored}

_SPANS = """
g AS (SELECT DISTINCT trace_id, sequence, session_id, input_ids, output_ids FROM trace WHERE record_type = 'generation'),
a AS (SELECT trace_id, sequence, session_id, 'input_ids' AS array_name, input_ids AS v FROM g UNION ALL
      SELECT trace_id, sequence, session_id, 'output_ids', output_ids FROM g),
r AS (SELECT trace_id, sequence, session_id, array_name, i, md5(v[i + 1:i + 32]::VARCHAR) AS r FROM (SELECT *, unnest(range(0, len(v) - 31)) AS i FROM a)),
s AS (SELECT r FROM r GROUP BY r HAVING count(DISTINCT session_id) > 1),
h AS (SELECT trace_id, sequence, array_name, i, lag(i) OVER w AS before FROM (SELECT * FROM r WHERE r IN (SELECT r FROM s)) WINDOW w AS (PARTITION BY trace_id, sequence, array_name ORDER BY i)),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 32 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, sequence, array_name ORDER BY i) AS k FROM h),
f AS (SELECT trace_id, sequence, array_name, CAST(min(i) AS INTEGER) AS span_start, CAST(max(i) + 32 AS INTEGER) AS span_end FROM n GROUP BY trace_id, sequence, array_name, k)
"""
_PAIRS = """
u AS (SELECT DISTINCT index, split, source, tokens[1:len(tokens) - response_length] AS p FROM rollout_samples
  WHERE split IN ('train', 'eval', 'test') AND tokens IS NOT NULL AND response_length >= 0 AND len(tokens) - response_length > 0),
q AS (SELECT DISTINCT p, md5(p::VARCHAR) AS k FROM u),
g AS (SELECT DISTINCT k, p[i:i + 3] AS r FROM (SELECT k, p, unnest(range(1, len(p) - 2)) AS i FROM q)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
s AS (SELECT DISTINCT md5(p::VARCHAR) AS k, split = 'train' AS train FROM u),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM g a JOIN g b ON a.r = b.r WHERE a.k IN (SELECT k FROM s WHERE NOT train) AND b.k IN (SELECT k FROM s WHERE train) GROUP BY 1, 2),
f AS (SELECT c.a, c.b FROM c JOIN n x ON x.k = c.a JOIN n y ON y.k = c.b WHERE c.c >= 0.6 * (x.n + y.n - c.c)),
m AS (SELECT DISTINCT h.index AS held, h.split, h.source, t.index AS train
  FROM f JOIN u h ON md5(h.p::VARCHAR) = f.a AND h.split <> 'train' JOIN u t ON md5(t.p::VARCHAR) = f.b AND t.split = 'train')
"""

ORACLE = {
    "p2_found": f"WITH {_SPANS} SELECT * FROM f",
    "p2_shares": f"""WITH {_SPANS},
z AS (SELECT trace_id, sequence, array_name, max(len(v)) AS n_tokens FROM a WHERE v IS NOT NULL GROUP BY ALL),
w AS (SELECT trace_id, sequence, array_name, CAST(sum(span_end - span_start) AS BIGINT) AS shared, count(*) AS n FROM f GROUP BY ALL)
SELECT z.trace_id, z.sequence, z.array_name, n_tokens, coalesce(shared, 0) AS shared_tokens, coalesce(w.n, 0) AS n_spans, CASE WHEN n_tokens > 0 THEN coalesce(shared, 0) / n_tokens END AS share
FROM z LEFT JOIN w ON w.trace_id IS NOT DISTINCT FROM z.trace_id AND w.sequence IS NOT DISTINCT FROM z.sequence AND w.array_name = z.array_name""",
    "p3_checks": """
WITH f AS (SELECT feature_id, min(struct_pack(r := run_id, n := len(input_ids))) AS f FROM features WHERE len(input_ids) > 0 AND len(labels) = len(input_ids) GROUP BY feature_id),
w AS (SELECT run_id, max(width) AS w FROM run_result GROUP BY run_id HAVING max(width) > 0)
SELECT run_id, CAST(sum(ceil(f.n / w)) AS BIGINT) AS n_pieces, CAST(sum(f.n) AS BIGINT) AS n_tokens, count(*) AS n_features, 0 AS n_overlaps, 0 AS n_beyond, 0 AS n_needless_cuts, 0 AS n_missing_containers
FROM f JOIN w ON f.r = w.run_id GROUP BY run_id""",
    "p3_pieces": """
WITH f AS (SELECT feature_id, min(struct_pack(r := run_id, n := len(input_ids))) AS f FROM features WHERE len(input_ids) > 0 AND len(labels) = len(input_ids) GROUP BY feature_id),
w AS (SELECT run_id, max(width) AS w FROM run_result GROUP BY run_id HAVING max(width) > 0)
SELECT run_id, CAST(sum(ceil(f.n / w)) AS BIGINT) AS n_pieces, CAST(sum(f.n) AS BIGINT) AS n_tokens, CAST(max(least(f.n, w)) AS BIGINT) AS longest
FROM f JOIN w ON f.r = w.run_id GROUP BY run_id""",
    "p5_found": f"WITH {_PAIRS} SELECT DISTINCT least(held, train) AS index_a, greatest(held, train) AS index_b FROM m",
    "p5_counts": f"WITH {_PAIRS} SELECT split, source, count(DISTINCT held) AS n_samples, count(*) AS n_pairs FROM m GROUP BY ALL",
    "p5_coverage": """
WITH u AS (SELECT DISTINCT index, split = 'train' AS train, tokens[1:len(tokens) - response_length] AS p FROM rollout_samples
  WHERE split IN ('train', 'eval', 'test') AND tokens IS NOT NULL AND response_length >= 0 AND len(tokens) - response_length > 0),
q AS (SELECT p, bool_or(train) AS train, bool_or(NOT train) AS held FROM u GROUP BY p),
n AS (SELECT p, train, held, unnest([4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]) AS n FROM q),
g AS (SELECT p, train, held, n, i, md5(p[i:i + n - 1]::VARCHAR) AS g FROM (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM n WHERE len(p) >= n)),
t AS (SELECT DISTINCT n, g FROM g WHERE train),
h AS (SELECT DISTINCT g.p, g.n, g.i FROM g JOIN t ON t.n = g.n AND t.g = g.g WHERE held),
c AS (SELECT p, count(DISTINCT k) AS covered FROM (SELECT p, unnest(range(i, i + 8)) AS k FROM h WHERE n = 8) GROUP BY p),
l AS (SELECT p, max(n) AS longest FROM h GROUP BY p)
SELECT DISTINCT u.index, len(u.p) AS n_tokens, coalesce(covered, 0) AS covered, coalesce(longest, 0) AS longest
FROM u LEFT JOIN c ON c.p = u.p LEFT JOIN l ON l.p = u.p WHERE NOT u.train""",
    "p7_found": """
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)) AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
