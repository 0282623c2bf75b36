"""The thin queries of the operators and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.llm import decontaminate, jaccard, language, licenses, packing, pii, quality, secrets, topk, toxicity
from barframe.llm.common import crc_mod, doc_text, table


def tokenizer_files() -> tuple[str, str]:
    """The public vocabulary and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _kinds(spans: str, kinds: tuple[str, ...]) -> list[Column]:
    def of(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    return [of(k).alias(f"n_{k}") for k in kinds]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(doc_text(table(spark, sf_dir, "documents")))
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*pii.KINDS))
    return found.select("doc_id", *_kinds("pii_spans", pii.KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    found = language.identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files(), with_ids=False)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(doc_text(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    found = quality.score(doc_text(docs), quality.train(docs, labels, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("license_places", lambda x: x["base"])

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")

    words = F.transform(base, lambda x: x["word"])
    n = F.size("license_places")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("license_places")).alias("labels"), (n / (n + F.lit(1.0))).alias("score"),
    )


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, "vec_id", "embedding", vectors.where(F.col("vec_id") % 50 == 0), 5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    found = toxicity.score(doc_text(docs), toxicity.train(docs, labels, ~held_out))
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.get("tox_hits", F.lit(0)).alias("n_exact"), F.get("tox_hits", F.lit(1)).alias("n_misspelled"), F.get("tox_hits", F.lit(2)).alias("n_quoted"),
    )


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(doc_text(table(spark, sf_dir, "documents"))).select("doc_id", "n_shingles", "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    names = tuple(r.name for r in secrets.BASE)
    base = F.filter("secret_spans", lambda x: x["kind"].isin(*names))
    return found.select("doc_id", *_kinds("secret_spans", names), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_language, op3_packing, op4_decontaminate, op5_quality, op6_licenses, op7_topk, op8_toxicity, op9_jaccard, op10_secrets)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TOKENS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"


def _license_sql() -> str:
    def places(phrase: str) -> str:
        words = phrase.split()
        return f"list_filter(generate_series(1, len(w)), lambda p: w[p:p+{len(words) - 1}] = {words!r})"

    found = []
    for t in licenses.TEMPLATES:
        key = f"CASE WHEN len({places(t.key)}) > 0 THEN {places(t.words)} ELSE [] END" if t.key else places(t.words)
        found.append((t, key))
    base = ", ".join(x for t, x in found if t.base)
    every = ", ".join(x for _, x in found)

    def labels(some) -> str:
        parts = ", ".join(f"CASE WHEN len({x}) > 0 THEN '{t.label}' END" for t, x in some)
        return f"array_to_string(list_sort(list_filter([{parts}], lambda x: x IS NOT NULL)), ',')"

    return f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT doc_id, w, flatten([{base}]) AS b, flatten([{every}]) AS e, {labels([x for x in found if x[0].base])} AS bl, {labels(found)} AS al FROM d)
    SELECT doc_id, len(w)::BIGINT AS n_words, len(b)::BIGINT AS n_base, (list_min(b) - 1)::BIGINT AS first_word, (list_max(b) - 1)::BIGINT AS last_word, bl AS base_labels, al AS labels, len(e) / (len(e) + 1.0::DOUBLE) AS score FROM p"""


ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
      i2 AS (SELECT item, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0), i3 AS (SELECT item, w, m, unnest(generate_series(1, len(w) - m + 1)) AS o FROM i2), win AS (SELECT DISTINCT item, m, array_to_string(w[o:o+m-1], ' ') AS k FROM i3),
      p1 AS (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m), pos AS (SELECT doc_id, m, p, array_to_string(w[p:p+m-1], ' ') AS k FROM p1),
      hit AS (SELECT pos.doc_id, pos.p, pos.m, win.item FROM pos JOIN win ON win.m = pos.m AND win.k = pos.k), cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + m - 1)) AS q FROM hit) GROUP BY doc_id),
      its AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
      SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, coalesce(its.s, sha256('')) AS items_sha256, cov.n IS NOT NULL AS contaminated FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op6_licenses": _license_sql(),
    "op7_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
      s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda p: concat_ws(' ', w[p], w[p+1], w[p+2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
      x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s), c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
      l AS (SELECT a, b FROM c WHERE 100 * c >= 90 * (na + nb - c)), r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
      SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.g""",
}
