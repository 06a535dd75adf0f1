"""The queries op1 to op13 and the pipeline, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, chat, collocations, decontaminate, divergence, embeddings, licenses, lines, mixing, quality, shards, simhash, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
RANKS = "byte_bpe_multi_50k.tiktoken"
_EXTRA = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{_EXTRA}'), (-1L, 1L, 'assistant', '{_EXTRA}') AS t(conv_id, turn, role, text)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    done = chat.format_chats(turns.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    read = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / language / document."""
    docs = _table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return licenses.scan(files).withColumn("cosine", F.round("cosine", 6))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, RULES, [F.col("html")]).select("page_id", "host", "path", "rule", "verdict")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.plan(_table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = lines.drop_lines(docs)
    return done.select("doc_id", F.size("dropped").alias("n_dropped"), F.length("text").alias("chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join("dropped", ",").alias("dropped"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    done = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, packed="packed", keep=["doc_id"])
    digests = [F.sha2("packed", 256).alias("ids_sha256"), F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256")]
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digests)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_chat, op2_licenses, op3_urls, op4_decontamination, op5_sharding, op6_lines, op7_mixing, op8_quality, op9_simhash, op10_embeddings, op11_divergence, op12_bpe, op13_collocations, pipeline)}

# What escaping adds: a backslash for each control string and each backslash.
_added = " + ".join([f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in chat.CONTROL] + ["length(text) - length(replace(text, '\\', ''))"])
_marks = len(chat.TURN + chat.TEXT + chat.END + "\n")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_key = "coalesce(doc_id::VARCHAR, 'null')"

ORACLES = {
    "op1_chat": f"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '{_EXTRA}' UNION ALL SELECT -1, 1, 'assistant', '{_EXTRA}'
        ), e AS (
          SELECT *, length(text) + {_added} + length(role) + {_marks} AS chars FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(chars)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    # DuckDB has no CRC-32: its table by the rule of the polynomial, then a fold over the bytes
    "op5_sharding": f"""
        WITH k AS (
          SELECT list(v ORDER BY i) AS table_ FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) AS t(i))
        ), d AS (
          SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size, {_key} AS key, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), b AS (
          SELECT doc_id, size, key, list_concat([4294967295], list_transform(range(0, length(h), 2), lambda i: ('0x' || h[i + 1:i + 2])::BIGINT)) AS bytes FROM d
        ), c AS (
          SELECT doc_id, size, key, xor(4294967295, list_reduce(bytes, lambda crc, x: xor(crc >> 8, table_[xor(crc & 255, x) + 1]))) AS text_crc32 FROM b, k
        ), p AS (
          SELECT *, {shards.place_sql("key", shards.tree(40))} AS shard, {shards.place_sql("key", shards.tree(41))} AS grown_shard FROM c
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
          row_number() OVER (PARTITION BY shard ORDER BY md5(key || '/' || size || '/' || text_crc32), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
        FROM p""",
    "op6_lines": rf"""
        WITH d AS (
          SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
        ), l AS (
          SELECT text, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT DISTINCT text, ls FROM d)
        ), w AS (
          SELECT text, i, string_split(regexp_replace(trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS ws
          FROM l WHERE trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g')) <> ''
        ), p AS (
          SELECT text, i, len(ws) AS n, len(ws) || '|' || array_to_string(ws[1:{lines.DEPTH}], ' ') AS leaf,
            list_concat([array_to_string(ws[1:{lines.DEPTH}], ' ')], ws[{lines.DEPTH + 1}:]) AS ps FROM w
        ), c AS (
          SELECT leaf, n, ps, count(DISTINCT text) AS m FROM p GROUP BY ALL
        ), x AS (
          SELECT leaf, n, ps, m, unnest(range(len(ps))) AS pos, unnest(ps) AS word FROM c
        ), f AS (
          SELECT leaf, pos, word, sum(m) AS c FROM x GROUP BY ALL HAVING sum(m) >= {lines.FEW}
        ), b AS (
          SELECT leaf, n, ps, (n * {lines.SIMILAR} + 99) // 100 - least(n, {lines.DEPTH}) AS k, list({{'pos': x.pos, 'word': x.word, 'c': f.c}} ORDER BY x.pos) AS fs,
            list(f.c ORDER BY f.c DESC) FILTER (x.pos > 0) AS cs, max(f.c) FILTER (x.pos = 0) AS head
          FROM x JOIN f USING (leaf, pos, word) GROUP BY leaf, n, ps
        ), r AS (
          SELECT leaf, n, ps, fs, CASE WHEN k > 0 THEN cs[k] ELSE head END AS rarest FROM b WHERE head IS NOT NULL AND (k <= 0 OR len(cs) >= k)
        ), t AS (
          SELECT leaf, n, ps, leaf || list_transform(list_filter(fs, lambda e: e.pos = 0 OR e.c * 2 >= rarest), lambda e: {{'pos': e.pos, 'word': e.word}})::VARCHAR AS t FROM r
        ), m AS (
          SELECT p.text, p.i, p.n, t.t FROM p JOIN t USING (leaf, n, ps)
        ), s AS (
          SELECT t, n, count(DISTINCT text) AS docs, least({lines.MIN_DOCS}, greatest({lines.FEW}, ceil({lines.MIN_DOCS * lines.SHORT} / n))) AS need FROM m GROUP BY t, n
        ), few AS (
          SELECT DISTINCT m.t, m.text, s.need FROM m JOIN s USING (t, n) WHERE s.docs >= s.need AND s.docs < {lines.MIN_DOCS}
        ), pairs AS (
          SELECT DISTINCT a.text AS one, b.text AS other FROM few AS a JOIN few AS b ON a.t = b.t AND a.text <> b.text
        ), size AS (
          SELECT text, count(*) AS lines FROM l WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> '' GROUP BY text
        ), related AS (
          SELECT one, other FROM pairs JOIN m AS a ON a.text = one JOIN m AS b ON b.text = other AND b.t = a.t JOIN size ON size.text = one
          GROUP BY one, other HAVING count(DISTINCT a.i) > {lines.RELATED} * any_value(size.lines)
        ), later AS (
          SELECT DISTINCT CASE WHEN md5(one) > md5(other) THEN one ELSE other END AS one, CASE WHEN md5(one) > md5(other) THEN other ELSE one END AS other FROM related
        ), often AS (
          SELECT t FROM s WHERE docs >= {lines.MIN_DOCS}
          UNION
          SELECT a.t FROM few AS a WHERE NOT EXISTS (SELECT 1 FROM few AS b JOIN later ON later.one = a.text AND later.other = b.text WHERE b.t = a.t) GROUP BY a.t HAVING count(*) >= any_value(a.need)
        ), gone AS (
          SELECT DISTINCT text, i FROM m SEMI JOIN often USING (t)
        ), left_ AS (
          SELECT l.text AS of_, count(g.i)::INT AS n_dropped, coalesce(string_agg(l.i::VARCHAR, ',' ORDER BY l.i) FILTER (g.i IS NOT NULL), '') AS dropped,
            coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS left_text
          FROM l LEFT JOIN gone g ON g.text = l.text AND g.i = l.i GROUP BY l.text
        )
        SELECT doc_id, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped, length(left_text)::INT AS chars_left, md5(left_text) AS text_md5
        FROM d LEFT JOIN left_ ON of_ = d.text""",
    "op7_mixing": """
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/' || md5(coalesce(text, '')) || '//' || (row_number() OVER (PARTITION BY doc_id, text, source) - 1)), 1, 13))::BIGINT AS h
          FROM documents
        ), s AS (
          SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
        ), w AS (
          SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
            (source_size * 2)::DOUBLE AS cap FROM s
        ), f AS (
          SELECT *, row_number() OVER o AS rank,
            sum(source_size) OVER () * 1.5::DOUBLE - (sum(cap) OVER (o ROWS UNBOUNDED PRECEDING) - cap) AS left_,
            sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
          FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
        ), l AS (
          SELECT arg_min({'left_': left_, 'w_left': w_left}, rank) AS lv FROM f WHERE w * left_ / w_left < cap
        ), g AS (
          SELECT source, source_size, CASE WHEN lv IS NULL THEN cap ELSE least(cap, w * lv.left_ / lv.w_left) END AS target FROM f, l
        ), r AS (
          SELECT d.*, g.source_size, g.target,
            CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS times,
            sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS until,
            sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
          FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
        ), x AS (
          SELECT *, target - times * source_size AS rest FROM r
        )
        SELECT doc_id, size::BIGINT AS size, source_size, target,
          (size * (times + CASE WHEN until <= rest OR (until - same <= rest AND until - rest < rest - (until - same)) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM x""",
    "op10_embeddings": """
        WITH RECURSIVE v AS (
          SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
          SELECT a.vec_id AS u, b.vec_id AS w FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), n AS (
          SELECT u, count(*) AS n FROM l GROUP BY u
        ), r AS (
          SELECT u AS s, u AS t FROM n UNION SELECT r.s, l.w FROM r JOIN l ON l.u = r.t
        ), c AS (
          SELECT s, min(t) AS component_id FROM r GROUP BY s
        )
        SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component_id, vec_id) AS component_id, vec_id = coalesce(c.component_id, vec_id) AS kept
        FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.s = vec_id""",
    "op11_divergence": rf"""
        WITH d AS (
          SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents
        ), w AS (
          SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), c AS (
          SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL
        ), k AS (
          SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY ALL HAVING count(DISTINCT i) >= {divergence.MIN_DOCS}
        ), v AS (
          SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS size FROM k GROUP BY lang
        ), g AS (
          SELECT lang, source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0)::HUGEINT AS size
          FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN k USING (lang, term) GROUP BY ALL
        ), p AS (
          SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.size + v.v) AS p, 1 + 1000000000::HUGEINT * (k.total + 1) // (v.size + v.v) AS q
          FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
        ), pair AS (
          SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), all_ AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
        )
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM all_
        QUALIFY part = 'pair' OR rank <= {divergence.TOP}""",
    "op13_collocations": rf"""
        WITH p AS (
          SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (
          SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
        ), one AS (
          SELECT lang, word, count(*) AS f FROM (SELECT lang, unnest(ws) AS word FROM w) GROUP BY ALL
        ), two AS (
          SELECT lang, x, y, count(*) AS a FROM (SELECT lang, unnest(list_zip(ws[:-2], ws[2:])) AS g, g[1] AS x, g[2] AS y FROM w WHERE len(ws) > 1) GROUP BY ALL HAVING count(*) >= {collocations.LEAST}
        ), three AS (
          SELECT lang, x, y, z, count(*) AS a FROM (SELECT lang, unnest(list_zip(ws[:-3], ws[2:-2], ws[3:])) AS g, g[1] AS x, g[2] AS y, g[3] AS z FROM w WHERE len(ws) > 2) GROUP BY ALL HAVING count(*) >= {collocations.LEAST}
        ), c AS (
          SELECT two.lang, x || ' ' || y AS phrase, a, 1 AS k, l.f AS l, r.f AS r FROM two JOIN one AS l ON l.lang = two.lang AND l.word = x JOIN one AS r ON r.lang = two.lang AND r.word = y
          WHERE NOT EXISTS (SELECT 1 FROM three AS t WHERE t.lang = two.lang AND (t.x = two.x AND t.y = two.y OR t.y = two.x AND t.z = two.y) AND 100 * t.a >= {collocations.COVERED} * two.a)
          UNION ALL
          SELECT t.lang, t.x || ' ' || t.y || ' ' || z, t.a, 1, l.f, r.a FROM three AS t JOIN one AS l ON l.lang = t.lang AND l.word = t.x JOIN two AS r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
          UNION ALL
          SELECT t.lang, t.x || ' ' || t.y || ' ' || z, t.a, 2, l.a, r.f FROM three AS t JOIN two AS l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN one AS r ON r.lang = t.lang AND r.word = t.z
        ), s AS (
          SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM s JOIN (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang) USING (lang) QUALIFY rank <= {collocations.TOP}""",
}
