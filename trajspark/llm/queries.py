"""Thin queries over the operators, one per operator, and the SQL that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import (exact, jaccard, mixing, neardup, ngram, packing, periods, phrases, pii, repeats, secrets, tokens,
                           toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def span_columns(df: DataFrame, kinds: list[str]) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    return df.select("doc_id", *(count_of(k) for k in kinds),
                     F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
                     joined(F.col("spans")).alias("spans"))


@query
def op10_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of every text: counts and digest of the base spans, and all spans."""
    return span_columns(secrets.secret_spans(table(spark, sf, "documents")), ["assign", "access", "hex"])


@query
def op1_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of equal texts."""
    groups = exact.exact_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op1_exact"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def crc_mod(column: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


@query
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all texts by a model that saw no held-out label; `rejected` goes by the language's threshold."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.train(docs, table(spark, sf, "labels").where(~out))
    scored = toxicity.score(docs, model, keep_text=False)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         "rejected")


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All texts as tokens in sequences of 2048."""
    return packing.pack(table(spark, sf, "documents"), tokenizer())


@query
def op2_neardup(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of all vectors."""
    return neardup.near_vectors(table(spark, sf, "embeddings"))


SQL["op2_neardup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.c AS component_id,
       v.vec_id = m.c AS kept
FROM v JOIN m ON m.id = v.vec_id
"""


@query
def op9_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of all texts by shared shingles."""
    return jaccard.jaccard_classes(table(spark, sf, "documents"))


@query
def op8_ngram(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all texts by a bigram model of the texts that aren't held out."""
    by = crc_mod("doc_id", 7)
    scored = ngram.score_texts(table(spark, sf, "documents"), by != 2, by == 3)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens",
                         "n_known", "train_tokens", "base_score", "score")


@query
def op6_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """What stays of all texts once passages of earlier documents are removed."""
    return repeats.remove_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of every text: counts and digest of the base spans, and all spans."""
    return span_columns(pii.personal_spans(table(spark, sf, "documents")), pii.KINDS)


@query
def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every document in the mixture."""
    return mixing.schedule(table(spark, sf, "documents"))


@query
def op12_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of all texts."""
    return tokens.token_counts(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def looped(text: Column, doc_id: Column) -> Column:
    """The text with its words from the a-th on repeated at a period, where the contract says so."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.concat(F.slice(w, F.lit(1), a), F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p)))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # Bound to a variable, so that the words are split once and not for each of them.
    some = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " "))), 0)
    return F.when(h % 10 == 0, some).otherwise(text)


@query
def op13_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of all texts: the one with most periods, digests of all and of the collapsed text."""
    docs = table(spark, sf, "documents")
    found = periods.periodic_runs(docs.select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text")))

    def order(a, b):
        more = b["length"] * a["period"] - a["length"] * b["period"]
        return F.when(more != 0, F.signum(more)).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])) \
            .otherwise(F.signum(a["period"] - b["period"])).cast("int")

    top = F.get(F.array_sort("runs", order), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "collapsed", top.alias("top"),
                        lines.alias("lines")).select(
        "doc_id", "n_runs", *(F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.encode("lines", "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


# A run of length n and period q has n - q >= 16 words in a row that equal those q on, hence n - q - 15 stretches of 16.
SQL["op13_periods"] = r"""
WITH c AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
  xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: list_reduce([xor(a, b), 1, 2, 3, 4, 5, 6, 7, 8],
      lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))) AS h FROM documents),
g AS (SELECT *, h // 10 AS g, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w
  FROM p),
k AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 16], ' ') AS k FROM t, unnest(range(n - 15)) u(i)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
e AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM e GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(24, 3 * q)
  GROUP BY doc_id, start, length),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id
    ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), ''
    ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
v AS (SELECT doc_id, i, w[i + 1] AS word FROM t, unnest(range(n)) u(i)),
o AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM v WHERE NOT EXISTS (SELECT 1 FROM r
    WHERE r.doc_id = v.doc_id AND v.i >= r.start + r.period AND v.i < r.start + r.length) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN o USING (doc_id)
"""


@query
def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The best phrases of each language."""
    return phrases.collocations(table(spark, sf, "documents"))


SQL["op11_phrases"] = r"""
WITH p AS (SELECT lang, row_number() OVER () AS id, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS MATERIALIZED (SELECT lang, id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k AS size, array_to_string(w[i + 1:i + k], ' ') AS phrase, count(*) AS f
  FROM w, unnest([1, 2, 3, 4, 5]) a(k), unnest(range(len(w) - k + 1)) b(i) GROUP BY ALL HAVING count(*) >= 100),
s AS (SELECT c.lang, c.phrase, c.f AS a, string_split(c.phrase, ' ') AS w, k, size FROM c, unnest(range(1, size)) u(k)
  WHERE size > 1),
x AS (SELECT s.lang, s.phrase, s.a, l.f AS l, r.f AS r, t.n, k,
    (CAST(1000 AS HUGEINT) * s.a * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS score FROM s
  JOIN c l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1:k], ' ')
  JOIN c r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[k + 1:], ' ') JOIN t ON t.lang = s.lang
  QUALIFY row_number() OVER (PARTITION BY s.lang, s.phrase ORDER BY score, k) = 1),
o AS (SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.lang = x.lang AND y.f >= x.a
    AND length(y.phrase) > length(x.phrase) AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
  CAST(score AS BIGINT) AS score FROM o QUALIFY rank <= 2000
"""
