"""Queries on the preparation of texts: citations and operators, chunks and pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import cleaning
from lectern.functions import preparation as P
from lectern.functions import text as T
from lectern.operators import documents, segments
from lectern.plans.catalog import SPACE, WORD, query, table

CHUNK, PAGE = 60, 50


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# What the texts hold is followed by references and formulas made of the row's own columns, so that all branches are met.
_NAME = "concat(upper(substr(lang, 1, 1)), substr(lang, 2))"
_MORE = f"""concat(text, ' (', {_NAME}, ', ', 1700 + doc_id % 400, ') [', doc_id % 40, ', ', doc_id % 7, '] (de ', {_NAME}, ' & Silva, 19', 10 + doc_id % 90, 'b, pp. ', doc_id, '-', doc_id + 9,
  ') (ver ', doc_id, ') (', {_NAME}, ' y ', {_NAME}, ' et al., s. f.; *', {_NAME}, '*, ', 2000 + doc_id % 150, ') [', {_NAME}, '] n=', doc_id, ' * (x + ', doc_id % 9, ') / y <= z, y/o a/b<c ', lang, ' >= ', source, '^2 != ', source, ' * !')"""


def _bracketed(column: str, pattern: str, opened: str, closed: str, cited: str) -> str:
    return rf"""array_to_string(list_transform(regexp_extract_all({column}, {_quoted(pattern)}), lambda x:
        CASE WHEN x[1] = '{opened}' AND x[-1] = '{closed}' AND length(x) > 2 AND ({cited}) THEN ' ' ELSE x END), '')"""


_SINGLE = f"regexp_replace(x[2:-2], '[{SPACE}]+', ' ', 'g')"
_CITED = f"regexp_matches(regexp_replace(trim(translate({_SINGLE}, '*_`~', '')), ' +', ' ', 'g'), {_quoted(P.CITATION)})"
_NUMBERED = f"regexp_matches(trim({_SINGLE}), {_quoted(P.NUMBERS)})"
_IS_SPACE = lambda k: f"coalesce(regexp_matches(ts[{k}], '^[{SPACE}]'), false)::INT"
_OPERAND = lambda x, marks: f"coalesce({x} IN ({marks}) OR regexp_matches({x}, {_quoted(P.OPERAND)}), false)"
_SPOKEN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in cleaning.SPOKEN.items()) + "}"
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
# i: the token's number from 1; b, a: the tokens before and behind it that aren't space
_TOKENS = rf"""list_transform(range(1, len(ts) + 1), lambda i: {{'t': ts[i], 'l': ts[i - 1], 'r': ts[i + 1], 'b': ts[i - 1 - {_IS_SPACE('i - 1')}],
  'j': i + 1 + {_IS_SPACE('i + 1')}}})"""
_AFTER = "CASE WHEN ts[e.j] IN ('+', '-') THEN ts[e.j + 1 + " + _IS_SPACE("e.j + 1") + "] ELSE ts[e.j] END"
_JUDGED = rf"""array_to_string(list_transform({_TOKENS}, lambda e: CASE WHEN e.t IN ({_LIST(P.ALWAYS)}) OR e.t IN ({_LIST(P.BETWEEN)})
  AND NOT (e.t = '/' AND coalesce(lower(e.l[-1]) = 'y' AND lower(e.r[1]) = 'o', false)) AND {_OPERAND('e.b', "')', ']'")} AND {_OPERAND('(' + _AFTER + ')', "'(', '['")}
  THEN ' ' || ({_SPOKEN})[e.t] || ' ' ELSE e.t END), '')"""
_DIVIDES = rf"regexp_matches(line, '^[{SPACE}]*(?:={{3,}}|-{{3,}}|(?:\*[{SPACE}]*){{3,}}|(?:_[{SPACE}]*){{3,}})[{SPACE}]*$')"
_TIDY = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(spoken, '•·▪▫■□◆◇○●◦*_`~|\#{}[]', repeat(' ', 22)), '\(\s+', '(', 'g'), '\s+\)', ')', 'g'), '\s+([,.;:!?¿¡])', '\1', 'g'), '([¿¡])\s+', '\1', 'g'), '[ \t\f\x0B]+', ' ', 'g'))"""


@query(rf"""
    WITH d AS (SELECT doc_id, {_MORE} AS t FROM documents), r AS (
      SELECT doc_id, t, {_bracketed('t', P.ROUND, '(', ')', _CITED)} AS x FROM d
    ), s AS (
      SELECT doc_id, t, {_bracketed('x', P.SQUARE, '[', ']', f'{_CITED} OR {_NUMBERED}')} AS x FROM r
    ), l AS (
      SELECT doc_id, unnest(range(len(string_split(x, chr(10))))) AS i, unnest(string_split(x, chr(10))) AS line FROM s
    ), k AS (
      SELECT doc_id, i, line, regexp_extract_all(line, {_quoted(P.TOKEN)}) AS ts FROM l
    ), o AS (
      SELECT doc_id, i, line, {_JUDGED} AS spoken FROM k
    ), c AS (
      SELECT doc_id, string_agg(CASE WHEN {_DIVIDES} THEN '' ELSE {_TIDY} END, chr(10) ORDER BY i) AS y FROM o GROUP BY doc_id
    )
    SELECT doc_id, length(t) - length(x) AS cited, length(trim(y, ' ' || chr(10) || chr(13) || chr(9))) AS chars, md5(trim(y, ' ' || chr(10) || chr(13) || chr(9))) AS digest FROM s JOIN c USING (doc_id)""")
def spoken_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts for reading aloud: without references, with operators in words, tidied line by line."""
    docs = table(spark, sf, "documents").select("doc_id", F.expr(_MORE).alias("t"))
    x = P.without_citations(F.col("t"))
    done = docs.select("doc_id", (F.length("t") - F.length(x)).alias("cited"), P.cleaned_text(F.col("t")).alias("y"))
    return done.select("doc_id", "cited", F.length("y").alias("chars"), F.md5(F.col("y").cast("binary")).alias("digest"))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as blocks, placed in their document; short ones are headings, some of the others list items."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    placed = documents.place(lines.select("doc_id", F.col("idx").cast("long").alias("idx"), T.js_trim(F.col("line")).alias("text")).where("text <> ''"))
    return placed.withColumn("kind", F.when(F.col("word_count") <= 9, "heading").when(F.col("idx") % 7 == 3, "bullet").otherwise("paragraph"))


_BLOCKS = rf"""l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS idx, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS text FROM documents), b AS (
      SELECT doc_id, idx, text, len(regexp_extract_all(text, '{WORD}')) AS n, coalesce(sum(length(text) + 2) OVER w, 0)::BIGINT AS start, coalesce(sum(len(regexp_extract_all(text, '{WORD}'))) OVER w, 0)::BIGINT AS start_word
      FROM l WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    )"""
_SHORT = ", ".join(f"'{a}'" for a in sorted(cleaning.ABBREVIATIONS))
_BARE = r"""regexp_replace(trim(raw), '[)\]"''»”’]+$', '')"""


@query(rf"""
    WITH RECURSIVE {_BLOCKS}, raw AS (
      SELECT doc_id, idx, unnest(range(len(us))) AS pos, unnest(us) AS raw FROM (SELECT doc_id, idx, regexp_extract_all(text, '[{SPACE}]*[^{SPACE}]+') AS us FROM b WHERE n > {CHUNK})
    ), u AS (
      SELECT doc_id, idx, pos, sum(length(raw)) OVER w - length(ltrim(raw, ' ' || chr(9))) AS start, sum(len(regexp_extract_all(raw, '{WORD}'))) OVER w AS words, sum(len(regexp_extract_all(raw, '{WORD}'))) OVER w - len(regexp_extract_all(raw, '{WORD}')) AS gone,
        regexp_matches({_BARE}, '[.!?]$') AS stops, lower({_BARE}) IN ({_SHORT}) OR regexp_matches(lower({_BARE}), '^(?:\p{{L}}\.)+$') AS short
      FROM raw WINDOW w AS (PARTITION BY doc_id, idx ORDER BY pos ROWS UNBOUNDED PRECEDING)
    ), e AS (
      SELECT doc_id, idx, gone + {CHUNK} AS v, 1 AS ask, pos, gone, NULL::BIGINT AS own FROM u
      UNION ALL SELECT doc_id, idx, words, 0, NULL, NULL, pos FROM u WHERE NOT (stops AND short)
    ), f AS (
      SELECT * FROM (
        SELECT doc_id, idx, ask, pos, gone, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id, idx ORDER BY v DESC, ask, own DESC ROWS UNBOUNDED PRECEDING) AS full_ FROM e
      ) WHERE ask = 1 AND full_ IS NOT NULL
    ), s AS (
      SELECT doc_id, idx, pos, max(CASE WHEN stops AND NOT short THEN pos END) OVER (PARTITION BY doc_id, idx ORDER BY pos ROWS UNBOUNDED PRECEDING) AS last_ FROM u
    ), p AS (
      SELECT f.doc_id, f.idx, f.pos, CASE WHEN s.last_ >= f.pos AND (l.words - f.gone) * 2 >= {CHUNK} THEN s.last_ ELSE f.full_ END + 1 AS next_
      FROM f JOIN s ON s.doc_id = f.doc_id AND s.idx = f.idx AND s.pos = f.full_ LEFT JOIN u AS l ON l.doc_id = s.doc_id AND l.idx = s.idx AND l.pos = s.last_
    ), walk AS (
      SELECT DISTINCT doc_id, idx, 0::BIGINT AS pos FROM u UNION ALL SELECT p.doc_id, p.idx, p.next_ FROM walk JOIN p USING (doc_id, idx, pos)
    ), piece AS (
      SELECT doc_id, b.start, n FROM b WHERE n BETWEEN 1 AND {CHUNK}
      UNION ALL
      SELECT doc_id, b.start + u.start, u.n FROM (
        SELECT doc_id, idx, u.start, coalesce(lead(gone) OVER (PARTITION BY doc_id, idx ORDER BY pos), b.n) - gone AS n FROM walk JOIN u USING (doc_id, idx, pos) JOIN b USING (doc_id, idx)
      ) AS u JOIN b USING (doc_id, idx) WHERE u.n > 0
    ), q AS (
      SELECT doc_id, start, row_number() OVER w - 1 AS pos, sum(n) OVER w AS words, sum(n) OVER w - n AS gone FROM piece WINDOW w AS (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING)
    ), h AS (
      SELECT doc_id, gone + {CHUNK} AS v, 1 AS ask, pos, NULL::BIGINT AS own FROM q UNION ALL SELECT doc_id, words, 0, NULL, pos FROM q
    ), g AS (
      SELECT doc_id, pos, own + 1 AS next_ FROM (
        SELECT doc_id, ask, pos, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY v DESC, ask, own DESC ROWS UNBOUNDED PRECEDING) AS own FROM h
      ) WHERE ask = 1 AND own IS NOT NULL
    ), went AS (
      SELECT DISTINCT doc_id, 0::BIGINT AS pos FROM q UNION ALL SELECT g.doc_id, g.next_ FROM went JOIN g USING (doc_id, pos)
    )
    SELECT doc_id, row_number() OVER w - 1 AS chunk, CASE WHEN pos = 0 THEN 0 ELSE start END::BIGINT AS start, lead(start) OVER w AS "end", gone::BIGINT AS start_word, (coalesce(lead(gone) OVER w, total) - gone)::BIGINT AS word_count
    FROM went JOIN q USING (doc_id, pos) JOIN (SELECT doc_id, max(words) AS total FROM q GROUP BY doc_id) USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def block_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return segments.chunks(_blocks(spark, sf), CHUNK)


@query(rf"""
    WITH RECURSIVE {_BLOCKS}, k AS (
      SELECT doc_id, idx, start_word AS s, start_word + n AS e, n <= 9 AS title FROM b
    ), d AS (
      SELECT doc_id, max(e) AS words FROM k GROUP BY doc_id
    ), first_ AS (
      SELECT p.doc_id, p.pos, p.words, CASE WHEN p.pos + {PAGE} < p.words THEN coalesce(max(k.s), p.pos + {PAGE}) ELSE p.words END AS e
      FROM (SELECT doc_id, words, unnest(range(0, words)) AS pos FROM d) AS p LEFT JOIN k ON k.doc_id = p.doc_id AND k.s > p.pos + {PAGE} * 0.5 AND k.s <= p.pos + {PAGE} GROUP BY p.doc_id, p.pos, p.words
    ), up AS (
      SELECT doc_id, pos, words, e FROM first_
      UNION ALL
      SELECT up.doc_id, up.pos, up.words, k.s FROM up JOIN k ON k.doc_id = up.doc_id AND k.title AND k.s > up.pos AND k.s < up.e AND up.e <= k.e AND up.e < up.words
    ), next_ AS (
      SELECT doc_id, pos, min(e) AS e FROM up GROUP BY doc_id, pos
    ), walk AS (
      SELECT doc_id, 0::BIGINT AS pos, 0 AS page FROM d WHERE words > 0 UNION ALL SELECT n.doc_id, n.e, walk.page + 1 FROM walk JOIN next_ AS n USING (doc_id, pos)
    )
    SELECT doc_id, page::BIGINT AS page, pos::BIGINT AS start_word, e::BIGINT AS end_word FROM walk JOIN next_ USING (doc_id, pos)""")
def block_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages cut before blocks and headings."""
    packed = _blocks(spark, sf).groupBy("doc_id").agg(F.sum("word_count").cast("int").alias("word_count"), F.sort_array(F.collect_list(F.struct("idx", "kind", F.col("start_word").cast("int").alias("start_word"), F.col("word_count").cast("int").alias("word_count")))).alias("blocks"))
    return documents.paginate(packed, PAGE)
