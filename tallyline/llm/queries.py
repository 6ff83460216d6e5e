"""Registered queries over the sample tables, one for each operator, with SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import (
    decontaminate,
    divergence,
    epsilon_grid,
    grouping_genetic,
    hyperminhash,
    language_mixture,
    licenses,
    line_dedup,
    packing,
    shallot,
    token_counts,
    url_filter,
    warc,
)
from tallyline.llm.frames import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- 1: URL filter

URL_RULES = tuple(
    url_filter.Rule(*rule)
    for rule in (
        ("allow", "com", "/"),
        ("block", "example.com", "/en/"),
        ("allow", "www.example.com", "/en/"),
        ("block", "net", "/es/"),
        ("block", "net", "/fr/"),
    )
)


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL, judged."""
    judged = url_filter.filter_urls(table(spark, folder, "pages").select("page_id", "url"), rules=URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _hits(terms: tuple[str, ...]) -> str:
    alone = r"(^|[^a-z0-9]){}($|[^a-z0-9])"
    escaped = (t.replace("-", r"\-") for t in terms)
    return " + ".join(f"CASE WHEN regexp_matches(low, '{alone.format(t)}') THEN 1 ELSE 0 END" for t in escaped)


def _fits(rule: url_filter.Rule) -> str:
    return (
        f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"
    )


_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r.text))
_TRANSLATED = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"
ORACLES["op1_url_filter"] = rf"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), {_TRANSLATED}) AS low,
         CASE WHEN position('://' IN coalesce(url, '')) > 0
              THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), {_TRANSLATED}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in _BY_LENGTH)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in _BY_LENGTH)}
       WHEN {_hits(url_filter.STRICT)} >= 1 THEN 'block'
       WHEN {_hits(url_filter.SOFT)} >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM split"""

QUERIES["op1_url_filter"] = op1_url_filter


# --- 2: line dedup


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the windows of lines that stood earlier."""
    cleaned = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


ORACLES["op2_line_dedup"] = """
WITH raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM raw
), shown AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n,
         count(*) OVER (PARTITION BY doc_id) AS many
  FROM numbered WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), named AS (
  SELECT doc_id, pos AS first, many,
         coalesce(lead(pos, 2) OVER place, lead(pos, 1) OVER place, pos) AS last,
         line AS a, lead(line, 1) OVER place AS b, lead(line, 2) OVER place AS c, n
  FROM shown WINDOW place AS (PARTITION BY doc_id ORDER BY pos)
), windows AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, first) AS time
  FROM named WHERE n <= greatest(many - 2, 1)
), gone AS (
  SELECT DISTINCT w.doc_id, l.pos FROM windows w JOIN numbered l ON w.doc_id = l.doc_id AND l.pos BETWEEN w.first AND w.last
  WHERE w.time > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM numbered l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE g.pos IS NULL GROUP BY l.doc_id
), lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT r.doc_id, CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(r.lines), 0) AS INT) AS n_lines, CAST(coalesce(l.n, 0) AS INT) AS n_removed
FROM raw r LEFT JOIN kept k ON r.doc_id = k.doc_id LEFT JOIN lost l ON r.doc_id = l.doc_id"""

QUERIES["op2_line_dedup"] = op2_line_dedup


# --- 3: benchmark decontamination


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, and which benchmark items it holds windows of."""
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), {}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_TRANSLATED)
ORACLES["op3_decontaminate"] = f"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark
), iw AS (
  SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS n FROM i WHERE len(words) > 0
), win AS (
  SELECT DISTINCT item, array_to_string(words[n:n + 9], ' ') AS win, least(len(words), 10) AS size FROM iw
), d AS (
  SELECT doc_id, {_WORDS} AS words FROM documents
), sizes AS (SELECT DISTINCT size FROM win),
dw AS (
  SELECT doc_id, size, words, unnest(range(1, greatest(len(words) - size + 1, 0) + 1)) AS n FROM d, sizes
), hit AS (
  SELECT dw.doc_id, dw.n, dw.size, win.item
  FROM (SELECT doc_id, n, size, array_to_string(words[n:n + size - 1], ' ') AS win FROM dw) dw JOIN win USING (win, size)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(n, n + size)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places p ON d.doc_id = p.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id"""

QUERIES["op3_decontaminate"] = op3_decontaminate


# --- 8: near duplicates


def op8_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its group of near duplicates, at 85 of 100 shingles in common."""
    found = hyperminhash.near_duplicates(table(spark, folder, "documents"), percent=85)
    is_first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", is_first.alias("kept"))


QUERIES["op8_hyperminhash"] = op8_hyperminhash


# --- 4: token counts


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's bytes and tokens."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(documents, tokenizer("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES["op4_token_counts"] = op4_token_counts


# --- 7: packing


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens in sequences of 4096."""
    packed = packing.pack(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), end=2)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES["op7_packing"] = op7_packing


# --- 5: WARC


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page, written to archives, normalised and read back."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    place = scratch(spark, "warc")
    written = warc.write_archives(warc.marked(pages, "page_id", "html"), f"{place}/whole")
    found = warc.read_archives(warc.normalise(written, f"{place}/records"), place)
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


QUERIES["op5_warc"] = op5_warc


# --- 6: language ID


def op6_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's main language, learned from four fifths of the documents."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    documents = documents.withColumn("held_out", language_mixture.held_out())
    model = language_mixture.learn(documents.where("NOT held_out"))
    judged = language_mixture.identify(documents.drop("lang"), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "languages")


QUERIES["op6_language_mixture"] = op6_language_mixture


# --- 9: near vectors


def op9_epsilon_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding with its links and its group, at a cosine of 0.95."""
    return epsilon_grid.near_vectors(table(spark, folder, "embeddings"))


QUERIES["op9_epsilon_grid"] = op9_epsilon_grid


# --- 10: license scan

# Documents as files of a tree: source/lang/hundred/id.txt. Each first document of a hundred,
# a thousand and ten thousand is the licence file of that part of the tree.
_PATH = """concat(
  coalesce(source, ''), CASE WHEN doc_id % 10000 = 0 THEN '' ELSE concat('/', coalesce(lang, ''),
    CASE WHEN doc_id % 1000 = 0 THEN '' ELSE concat('/', CAST(doc_id {div} 100 AS {text})) END) END,
  CASE WHEN doc_id % 100 = 0 THEN '/LICENSE' ELSE concat('/', CAST(doc_id AS {text}), '.txt') END)"""


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a file, with its licence or the one it inherits."""
    path = F.expr(_PATH.format(text="string", div="div"))
    files = table(spark, folder, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files, keep=["doc_id"])


def _license_sql() -> str:
    weights = licenses.Weights(licenses.TEMPLATES, licenses.LEAST)
    words = ", ".join(f"('{t}', {w!r}e0)" for t, w in weights.idf.items())
    common = ", ".join(f"'{word}'" for word in sorted(licenses.COMMON))
    rows = ", ".join(f"({i}, '{n}', '{t}', {w!r}e0)" for i, n, t, w in weights.rows)
    file_name = "regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$')"
    return f"""
WITH idf(token, idf) AS (VALUES {words}),
tmpl(template, license, token, weight) AS (VALUES {rows}),
f AS (SELECT doc_id, {_PATH.format(text="VARCHAR", div="//")} AS path, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM f),
paras AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n([^\\p{{L}}\\p{{N}}\\n]*\\n)+')) AS para FROM f),
seg AS (
  SELECT row_number() OVER () AS s, doc_id, part FROM (
    SELECT doc_id, unnest(string_split(regexp_replace(line, '([.;!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS part FROM lines
    UNION ALL SELECT doc_id, para FROM paras WHERE contains(trim(para, ' '), chr(10))
    UNION ALL SELECT doc_id, part FROM (
      SELECT doc_id, unnest(string_split(regexp_replace(para, '([.;!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS part FROM paras)
      WHERE contains(trim(part, ' '), chr(10))
    UNION ALL SELECT doc_id, text FROM f WHERE {file_name})
), tok AS (
  SELECT s, doc_id, unnest(regexp_extract_all(translate(part, {_TRANSLATED}), '[a-z0-9]+')) AS token FROM seg
), tf AS (
  SELECT s, doc_id, tok.token, count(*) * coalesce(max(idf.idf), {weights.unknown!r}e0) AS w
  FROM tok LEFT JOIN idf ON tok.token = idf.token WHERE tok.token NOT IN ({common}) GROUP BY s, doc_id, tok.token
), len AS (SELECT s, sqrt(sum(w * w)) AS length FROM tf GROUP BY s),
dot AS (
  SELECT s, doc_id, template, license, sum(w * weight) AS product FROM tf JOIN tmpl ON tf.token = tmpl.token
  GROUP BY s, doc_id, template, license
), best AS (
  SELECT dot.doc_id, license, round(round(product, 9) / length, 6) AS cosine,
         row_number() OVER (PARTITION BY dot.doc_id ORDER BY round(round(product, 9) / length, 6) DESC, license) AS n
  FROM dot JOIN len ON dot.s = len.s
), told AS (
  SELECT f.doc_id, f.path, regexp_replace(f.path, '/?[^/]*$', '') AS dir, license, cosine
  FROM f LEFT JOIN (SELECT * FROM best WHERE n = 1 AND cosine >= {licenses.LEAST}) b ON f.doc_id = b.doc_id
), named AS (
  SELECT dir AS above, license AS license_, cosine AS cosine_, path AS file_,
         row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license, path) AS n
  FROM told WHERE license IS NOT NULL AND {file_name}
), near AS (
  SELECT dir, license_, cosine_, file_, row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) AS n
  FROM (SELECT DISTINCT dir FROM told) d JOIN (SELECT * FROM named WHERE n = 1) a
    ON above = '' OR dir = above OR starts_with(dir, above || '/')
)
SELECT doc_id, path, coalesce(license, license_) AS license, coalesce(cosine, cosine_) AS cosine,
       CASE WHEN license IS NOT NULL THEN 'own' WHEN license_ IS NOT NULL THEN 'inherited' END AS found,
       CASE WHEN license IS NULL THEN file_ END AS file
FROM told LEFT JOIN (SELECT * FROM near WHERE n = 1) near ON told.dir = near.dir"""


ORACLES["op10_licenses"] = _license_sql()
QUERIES["op10_licenses"] = op10_licenses



# --- 12: source divergence audit


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Every two sources of a language with their distance, and each source's own terms."""
    return divergence.divergence(table(spark, folder, "documents"))


_TERMS = r"regexp_extract_all(translate(text, {}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')".format(_TRANSLATED)


def _price_sql(count: str, total: str) -> str:
    return (
        f"CAST(1 + (CAST({divergence.SCALE} AS HUGEINT) * ({count} + {divergence.MORE})) "
        f"// nullif(CAST({total} AS HUGEINT) + {divergence.MORE} * v, 0) AS BIGINT)"
    )


ORACLES["op12_source_divergence"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents
), t AS (
  SELECT doc, lang, source, unnest({_TERMS}) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS often FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {divergence.LEAST}
), langs AS (
  SELECT l.lang, count(term) AS v, coalesce(sum(often), 0) AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept USING (lang) GROUP BY l.lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT lang, source, coalesce(sum(c.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS times, {_price_sql("coalesce(c.n, 0)", "g.n")} AS p,
         {_price_sql("kept.often", "langs.n")} AS q
  FROM g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE times > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM both_parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}"""

QUERIES["op12_source_divergence"] = op12_source_divergence


# --- 11: centroid clustering


def op11_shallot_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable embedding with its one of eight clusters after ten rounds."""
    return shallot.cluster(table(spark, folder, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) AS INT) - 1 AS cluster, x AS place FROM (
    SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, x FROM kept ORDER BY h LIMIT {k})
)"""]
    nearest = """, a{0} AS MATERIALIZED (
  SELECT n, x, cluster, distance FROM (
    SELECT n, x, cluster, distance, row_number() OVER (PARTITION BY n ORDER BY distance, cluster) AS r FROM (
      SELECT n, x, cluster, list_sum(list_transform(list_zip(x, place), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
      FROM kept, c{0})) WHERE r = 1
)"""
    for i in range(rounds):
        steps.append(nearest.format(i))
        steps.append(f""", c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.place, c.place) AS place FROM c{i} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % many) + many) % many) // many AS BIGINT) ORDER BY axis) AS place FROM (
      SELECT cluster, axis, CAST(sum(v) AS HUGEINT) AS s, count(*) AS many
      FROM (SELECT cluster, unnest(x) AS v, unnest(range(64)) AS axis FROM a{i}) GROUP BY cluster, axis) GROUP BY cluster) m
  ON c.cluster = m.cluster
)""")
    steps.append(nearest.format(rounds))
    steps.append(f"""
SELECT kept.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.place, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept ON a.n = kept.n JOIN c{rounds} c ON a.cluster = c.cluster""")
    return "".join(steps)


ORACLES["op11_shallot_clusters"] = _cluster_sql()

QUERIES["op11_shallot_clusters"] = op11_shallot_clusters


# --- 13: best-fit packing


def op13_grouping_genetic(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens in as few sequences of 4096 as islands of packings find."""
    documents = table(spark, folder, "documents")
    pieces = grouping_genetic.cut(documents, tokenizer("word_bpe_49k.json"), end=1, capacity=grouping_genetic.CAPACITY)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return grouping_genetic.place(pieces, "length").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


QUERIES["op13_grouping_genetic"] = op13_grouping_genetic
