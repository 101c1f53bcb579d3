"""One query per text operator over the given tables, with a SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm import ann, bpe, exact_dedup, license_scan, line_dedup, mixing, ngram_join, periodic_runs, simhash, source_audit, suffix_dedup, token_count, toxicity
from fairlead.llm.common import file_cleanup, table

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[build.__name__] = build
        if sql:
            SQL[build.__name__] = sql
        return build

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    file_cleanup(spark)
    return table(spark, sf_dir, "documents", "doc_id", "text")


def rank_file() -> tuple[str, str]:
    """Place and splitting pattern of the byte-level rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def older_half():
    """Which rows stand for the snapshots that are already there: those with an odd digest of the id."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1


@query()
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), *rank_file())


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), words=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    sql=f"""
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
    """
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, sf_dir), older_half())


@query(
    sql=rf"""
    WITH d AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(57344)), chr(57344)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM d),
    ll AS (SELECT *, sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY n) - strlen(line) AS start, string_split(regexp_replace(line, '([.!?][ \t]+|[{line_dedup.MARKS}])', '\1' || chr(57344), 'g'), chr(57344)) AS ps,
           trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g')) AS whole FROM l),
    s AS (SELECT doc_id, n, start, whole, unnest(ps) AS part, generate_subscripts(ps, 1) AS k FROM ll),
    p AS (SELECT *, start + sum(strlen(part)) OVER (PARTITION BY doc_id, n ORDER BY k) - strlen(part) AS part_start,
                 trim(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g')) AS unit FROM s),
    u AS (SELECT doc_id, n, 0 AS k, start, strlen(line) AS length, whole AS unit FROM ll WHERE whole <> ''
          UNION ALL SELECT doc_id, n, k, part_start, strlen(part), unit FROM p WHERE strlen(unit) >= {line_dedup.LEAST_BYTES} AND unit <> whole),
    r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, start) > 1 AS gone FROM u),
    g AS (SELECT r.*, r.k = 0 OR coalesce(NOT o.gone, true) AS outermost FROM r LEFT JOIN (SELECT doc_id, n, gone FROM r WHERE k = 0) o USING (doc_id, n) WHERE r.gone),
    c AS (SELECT doc_id, count(*) AS n_units FROM u GROUP BY doc_id),
    x AS (SELECT doc_id, count(*) AS n_removed, string_agg(start::BIGINT || '-' || (start + length)::BIGINT, ',' ORDER BY start) AS removed FROM g WHERE outermost GROUP BY doc_id),
    t AS (SELECT p.doc_id, string_agg(part, '' ORDER BY p.n, p.k) AS kept FROM p
          WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.n = p.n AND (g.k = 0 OR g.k = p.k)) GROUP BY p.doc_id)
    SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN t USING (doc_id)
    """
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    spans = F.coalesce("removed", F.array().cast("array<struct<start:long,end:long>>"))
    written = F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_units", F.size(spans).cast("long").alias("n_removed"), written.alias("removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "toxic"))


@query()
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    file_cleanup(spark)
    found = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return found.select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.decode() + "'" for w in words) + "]"


_KNOWN = license_scan.Templates.of(license_scan.TEMPLATES)
_RUN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


@query(
    sql=f"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(t, {_RUN}) AS ws FROM d),
    phrases(label, ps) AS (VALUES {", ".join(f"('{label}', {_listed(license_scan.words_of(p.encode()))})" for p, label in license_scan.PHRASES.items())}),
    places AS (SELECT doc_id, label, unnest(list_filter(range(0, len(ws) - len(ps) + 1), lambda i: ws[i + 1:i + len(ps)] = ps)) AS place FROM w, phrases),
    templates(label, ts) AS (VALUES {", ".join(f"('{label}', {_listed(sorted(s))})" for label, s in zip(_KNOWN.labels, _KNOWN.sets, strict=True))}),
    lines AS (SELECT doc_id, unnest(list_transform(string_split(t, chr(10)), lambda x: regexp_extract_all(x, {_RUN}))) AS ws FROM d),
    blocks AS (SELECT doc_id, unnest(CASE WHEN len(ws) <= {2 * _KNOWN.longest} THEN [ws]
      ELSE list_transform(range(0, len(ws) - {_KNOWN.longest}, {_KNOWN.longest}), lambda i: ws[i + 1:i + {2 * _KNOWN.longest}]) END) AS ws FROM lines WHERE len(ws) > 0),
    hits AS (SELECT doc_id, label, n / size AS share FROM (
      SELECT doc_id, label, len(list_intersect(ws, ts))::DOUBLE AS n, len(ts) AS size FROM blocks, templates) WHERE n >= ceil({license_scan.THRESHOLD} * size - 1e-9)),
    base AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n, max(share) AS share FROM hits GROUP BY doc_id),
    named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM hits) GROUP BY doc_id)
    SELECT w.doc_id, len(ws) AS n_words, coalesce(base.n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(base.labels, '') AS base_labels,
      coalesce(named.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1e0 ELSE coalesce(share, 0e0) END AS score, coalesce(found.n, 0) AS n_blocks
    FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN named USING (doc_id)
    """
)
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(documents(spark, sf_dir))
    written = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first").alias("first_word"),
        F.array_max("places.first").alias("last_word"),
        written(F.col("places.label")).alias("base_labels"),
        written(F.concat("places.label", "blocks.label")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )


@query()
def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_count.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > 4096)


@query()
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    file_cleanup(spark)
    return ann.neighbours(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query(
    sql="""
    WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
    w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
    f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
    hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN f USING (s) WHERE first < doc_id),
    run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
    span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
    gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM (SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, n, n FROM d)),
    kept AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
    lost AS (SELECT doc_id, sum(b - a)::BIGINT AS bytes, count(*) AS spans FROM span GROUP BY doc_id)
    SELECT d.doc_id, n AS n_bytes, coalesce(bytes, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
    FROM d JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
    """
)
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_strings(documents(spark, sf_dir), length=50)
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    sql=rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
          ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
    r(node, label) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.label FROM r JOIN l ON l.a = r.node WHERE r.label < l.b),
    m AS (SELECT node, min(label) AS label FROM r GROUP BY node)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.label, d.doc_id)) AS component_id
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
    """
)
def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir))


@query(
    sql=rf"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
               '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    w AS (SELECT doc_id, lang, source, unnest(ws) AS term FROM d),
    k AS (SELECT lang, term FROM (SELECT DISTINCT lang, term, doc_id FROM w) GROUP BY lang, term HAVING count(*) >= 3),
    v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
    t AS (SELECT lang, source, coalesce(n, 0) + coalesce(v, 0) AS t FROM g LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // t.t::HUGEINT AS p
          FROM g JOIN k USING (lang) JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
    q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + v)::HUGEINT AS q
          FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
          ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
    """
)
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    file_cleanup(spark)
    return source_audit.audit(table(spark, sf_dir, "documents", "lang", "source", "text"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where the texts of one document in ten repeat a stretch of their words to the end."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.select("doc_id", "text", F.call_function("div", crc, F.lit(10)).alias("g"), (crc % 10 == 0).alias("planted"))
    split = split.withColumn("words", F.when(F.col("planted"), words)).withColumn("n", F.nullif(F.size("words"), F.lit(0)))
    first = F.pmod("g", F.col("n"))
    length = F.expr("1 + ((n - pmod(g, n)) div (3 + g % 8))")
    place = lambda i: F.when(i < first, i).otherwise(first + (i - first) % length)
    # sequence() takes places of a text, so they are counted as numbers of one kind.
    repeated = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.lit(1).cast("long")), lambda i: F.element_at("words", (place(i) + 1).cast("int")))
    return split.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(documents(spark, sf_dir)))
    # Of two exponents the greater one, without division: cross products.
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(better(b, a), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    written = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
