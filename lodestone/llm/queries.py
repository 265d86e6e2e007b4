"""The registered queries of this subpackage, one an operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import collisions, exact_dedup, lattice, licenses, packing, pieces, prefix_trie, runs, secrets, simhash, token_files, toxicity, wordpiece
from lodestone.llm.common import stored


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is; the files are never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def _is(value: str):
    return lambda x: x == F.lit(value)


def secret_digest(found: DataFrame) -> DataFrame:
    """The contract's columns, and how many spans are live."""
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select("doc_id", *counts, F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list("spans").alias("spans"), live)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def _op2_sql() -> str:
    """The same in SQL; a maximal run of key characters is tested where the pattern looks ahead."""
    quoted = [p.replace("'", "''") for p in (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, "[A-Za-z0-9+/_=-]{20,}")]
    fine = ("length(value) >= 12", "true", "true", "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')")
    kinds = [*secrets.BASE, secrets.OWNED]
    one = """SELECT doc_id, owner, repo, '{kind}' AS kind, {rank} AS rank, start, stop, value FROM (
      SELECT doc_id, owner, repo, i, stop - length(piece) AS start, stop, {value} AS value FROM (
        SELECT doc_id, owner, repo, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
          SELECT doc_id, owner, repo, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (
            SELECT doc_id, owner, repo, string_split(regexp_replace(x, '{pattern}', chr(57344) || '\\0' || chr(57344), 'g'), chr(57344)) AS l FROM t))))
      WHERE i % 2 = 0 AND {fine}"""
    parts = [one.format(kind=k, rank=r, pattern=p, fine=f, value=f"regexp_extract(piece, '{p}', 2)" if not r else "piece") for r, (k, p, f) in enumerate(zip(kinds, quoted, fine))]
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo, translate(coalesce(text, ''), chr(57344), chr(65533)) AS x FROM documents),
c AS ({" UNION ALL ".join(parts)}),
o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM c GROUP BY 1),
j AS (SELECT c.*, owners <= {secrets.MAX_OWNERS} AND repos <= {secrets.MAX_REPOS} AND NOT regexp_matches(c.value, '{secrets._PLACEHOLDER}') AND len(list_distinct(string_split(c.value, ''))) >= 6 AS live,
        c.kind || ':' || start || ':' || stop AS span FROM c JOIN o ON c.value = o.value),
d AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base, string_agg(span, ',' ORDER BY start, rank) AS spans, count(*) FILTER (live) AS n_live
      FROM j WHERE rank < 3 OR live GROUP BY 1)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM t LEFT JOIN d ON t.doc_id = d.doc_id"""


def license_digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    starts = F.flatten(F.transform("base", lambda b: b["starts"]))
    base = F.array_sort(F.array_distinct(F.transform(F.filter("base", lambda b: F.size(b["starts"]) > 0), lambda b: b["label"])))
    none = F.array().cast("array<string>")
    more = F.coalesce(F.transform("aligned", lambda a: a["label"]), none)
    score = F.coalesce(F.array_max(F.transform("aligned", lambda a: a["score"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(starts), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.coalesce(base, none), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce(base, none), more))), ",").alias("labels"),
        F.round(score, 6).alias("score"),
    )


def _op3_sql() -> str:
    """The same in SQL, with the templates and phrases as constants."""
    text = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"({t}, '{label}', {text(licenses.words_of(notice))}, {text(licenses.words_of(key))}, {at})" for t, label, notice, key, at in licenses.templates())
    phrases = ", ".join(f"({text(p.split() + [''] * (3 - len(p.split())))}, '{label}')" for p, label in licenses.BASE_PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
tpl(t, label, words, key, kat) AS (VALUES {rows}),
ph(p, label) AS (VALUES {phrases}),
occ AS (SELECT doc_id, word, spot, lead(word, 1, '') OVER x AS w1, lead(word, 2, '') OVER x AS w2
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS spot FROM d) WINDOW x AS (PARTITION BY doc_id ORDER BY spot)),
b AS (SELECT doc_id, label, spot FROM occ JOIN ph ON word = p[1] AND w1 = p[2] AND (p[3] = '' OR w2 = p[3])),
pos AS (SELECT t, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM tpl),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM occ WHERE word IN (SELECT word FROM pos) GROUP BY 1),
idf AS (SELECT word, ln((n + 1) / (coalesce(df, 0) + 1)) + 1e-6 AS idf FROM (SELECT DISTINCT word FROM pos) LEFT JOIN df USING (word), (SELECT count(*) AS n FROM d)),
rare AS (SELECT t, word, place, idf FROM pos JOIN idf USING (word) QUALIFY row_number() OVER (PARTITION BY t ORDER BY idf DESC, place) <= {licenses.TEMPLATE_WORDS}),
post AS (SELECT t, word, place, idf / sum(idf) OVER (PARTITION BY t) AS weight FROM rare),
agreed AS (SELECT doc_id, t, spot - place AS o, sum(weight) AS share FROM occ JOIN post USING (word) GROUP BY 1, 2, 3 HAVING sum(weight) >= {licenses.AGREE}),
good AS (SELECT doc_id, label, least(share, 1.0) AS share FROM agreed JOIN d USING (doc_id) JOIN tpl USING (t) WHERE o + kat >= 0 AND list_slice(w, o + kat + 1, o + kat + len(key)) = key),
base AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION ALL SELECT doc_id, label FROM good) GROUP BY 1),
best AS (SELECT doc_id, max(share) AS score FROM good GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)"""


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def toxicity_chain(spark: SparkSession, sf_dir: str) -> toxicity.Chain:
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), toxicity_chain(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), keep_ids=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n_points DESC, doc_id)
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer())
    return token_files.token_file_digests(spark, root)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs; lattice hashing misses none of them on these tables (see the README).
OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (
  SELECT vec_id, vec_id AS reached FROM v
  UNION
  SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT v.vec_id,
       (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links,
       (SELECT min(reached) FROM r WHERE r.vec_id = v.vec_id) AS component_id,
       (SELECT min(reached) FROM r WHERE r.vec_id = v.vec_id) = v.vec_id AS kept
FROM v
"""


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return collisions.search(collisions.build_index(vectors, k=20), vectors.where("vec_id % 20 = 0"))


def _crc32_sql(number: str) -> str:
    """The CRC-32 of a number's decimal digits in SQL, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)"
    digits = f"list_transform(string_split({number}::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {digits}), lambda c, b: {bits}), 4294967295::UBIGINT)::BIGINT"


#: Every node with its whole prefix as its name, and sums over all nodes that it begins.
OP12_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_crc32_sql("conv_id")} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h),
k AS (SELECT c.conv_id, h, count(r.pos) AS n FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY 1, 2),
p AS (SELECT * FROM r UNION ALL SELECT t.conv_id, pos - h + n, role, text FROM t JOIN k ON t.conv_id = k.conv_id WHERE pos > h),
l AS (SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS turns FROM c LEFT JOIN p ON p.conv_id = c.conv_id GROUP BY 1),
o AS (SELECT conv_id, len(turns) AS length, depth, list_slice(turns, 1, depth) AS prefix, CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS tokens FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM l)),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, min(tokens) AS tokens, max(length) AS deepest, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth) AS ends FROM o GROUP BY 1, 2),
a AS (SELECT *, list_slice(prefix, 1, high) AS above FROM (SELECT *, unnest(range(depth + 1)) AS high FROM n)),
s AS (SELECT high, above, sum((n_convs - 1) * tokens)::BIGINT AS saved_tokens, count(*) FILTER (deepest = depth) AS n_leaves, count(*) FILTER (depth = high + 1) AS n_children FROM a GROUP BY 1, 2)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN s ON high = n.depth AND above = n.prefix LEFT JOIN n q ON q.depth = n.depth - 1 AND q.prefix = list_slice(n.prefix, 1, n.depth - 1)"""

#: Every pair of equal words gives a place at which a period holds; stretches of such places are the
#: runs, the smallest period of each stretch counts.
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32_sql("doc_id")} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS f FROM d),
m AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // f) + 1] END) ELSE w END AS w FROM g),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i, len(w) AS n FROM m),
e AS (SELECT b.doc_id, b.i, c.i - b.i AS q FROM x b JOIN x c ON b.doc_id = c.doc_id AND b.word = c.word AND c.i > b.i AND 4 * (c.i - b.i) <= b.n),
y AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
z AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS t FROM y GROUP BY doc_id, q, island HAVING max(i) + 1 + q - min(i) >= greatest(6, 4 * q)),
r AS (SELECT doc_id, s, t - s AS l, min(q) AS q FROM z GROUP BY doc_id, s, t),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) = 1),
u AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY 1),
v AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.s + r.q AND x.i < r.s + r.l) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN v ON v.doc_id = d.doc_id"""


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = prefix_trie.with_shared_beginnings(stored(prefix_trie.number_turns(table(spark, sf_dir, "conversations")), "trie-turns"))
    return prefix_trie.prefix_trie(turns, members)


def run_digest(found: DataFrame) -> DataFrame:
    """The contract's columns; ratios are compared as fractions, by cross-multiplying."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))

    def better(best, r):
        more = r["length"] * best["period"]
        same = best["length"] * r["period"]
        return F.when(best.isNull() | (more > same), r).otherwise(best)  # runs come by start, then period

    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(runs.periodic_runs(runs.with_planted_runs(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_best_fit_packing,
            op2_secret_scans,
            op3_license_scans,
            op4_toxicity,
            op5_token_counts,
            op6_simhash_near_dedup,
            op7_sentencepiece,
            op8_exact_dedup,
            op9_token_files,
            op10_embedding_near_dedup,
            op11_nearest_neighbours,
            op12_conversation_prefix_trie,
            op13_periodic_runs,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scans": _op2_sql(), "op3_license_scans": _op3_sql(), "op8_exact_dedup": OP8_SQL, "op10_embedding_near_dedup": OP10_SQL, "op12_conversation_prefix_trie": OP12_SQL, "op13_periodic_runs": OP13_SQL}
