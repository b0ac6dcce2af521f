"""Line deduplication with a fixed-depth log-template tree.

A line descends the tree by its token count and then by its tokens in PIECES steps of equally many tokens, a token with
a digit being the wildcard <*>. A leaf's template generalises one variable field more: two neighbouring pieces, at most
a quarter of a line of eight tokens and more, may hold anything. So a line has one key for each place of that field, and
lines are of one template if they share a key: as many tokens, and all tokens outside the field the same. Lines of
fewer than FIELD tokens have no field and one key. Keys are computed from the line alone; nothing is parsed in order.

A template recurs when it stands in enough distinct texts that are not copies of each other, whatever its neighbours
are. A text is taken for no copy if more than two fifths of it stand in no other distinct text, by the characters of
its passages: lines are cut before words with one of a few first letters, and passages shorter than PASSAGE don't
count. Copies, edited ones included, are so neither counted nor in the way, however many there are.
Lines of recurring templates are dropped wherever they stand. Short templates need more texts; a line counts only if at
least half of its tokens are constants, that is, hold a letter and no digit, since numbers and rules of symbols have no
text that could recur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, blank, forget, hot_keys, materialize, quoted, spread_join, table, unfold, whole_row

PIECES = 8
FIELD = 4  # tokens from which a line has a variable field
LEAST = ((8, 3), (4, 5), (1, 10))  # (tokens, texts): from so many tokens a template recurs in so many texts
PASSAGE = 20  # characters
CUT = " (?=[lnpwLNPW])"  # before about one word in seven
SYMBOL = r"[\x00-\x08\x0E-\x1F\x21-\x40\x5B-\x60\x7B-\x7F]"  # a token without letters begins with one
LETTER = r"[A-Za-z]|[^\x00-\x7F]"


def parsed_lines(lines: DataFrame) -> DataFrame:
    """lines(..., line) -> (..., words, need, keys, marks): the number of tokens, in how many texts a template of such
    tokens must recur (null for a line with too few constants), the line's keys, one for each place of the variable
    field, and its passages.

    Each select computes what the next one uses several times."""
    kept = [c for c in lines.columns if c != "line"]
    spaced = F.when(F.col("line").rlike("[\\x09-\\x0D]"), F.translate("line", "\t\x0b\x0c\r", "    ")).otherwise(F.col("line"))
    passages = F.filter(F.split("line", CUT, -1), lambda x: F.length(x) >= PASSAGE)
    marks = F.transform(passages, lambda x: F.struct(F.xxhash64(x).alias("mark"), F.length(x).alias("size")))
    odd = spaced.rlike(" " + SYMBOL) | F.substring("line", 1, 1).rlike(SYMBOL) | F.col("line").rlike("[0-9]")  # few lines are, and only these are looked at token by token
    tokens = lines.select(*kept, odd.alias("odd"), marks.alias("marks"), F.array_remove(F.split(spaced, " ", -1), "").alias("w"))
    masked = F.when(F.col("odd"), F.transform("w", lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))).otherwise(F.col("w"))
    tokens = tokens.select(*kept, "marks", "odd", F.size("w").alias("words"), masked.alias("m"))
    constants = F.when(F.col("odd"), F.size(F.filter("m", lambda t: t.rlike(LETTER) & (t != "<*>")))).otherwise(F.col("words"))
    at = [F.floor(F.col("words") * j / PIECES).cast("int") for j in range(PIECES + 1)]
    pieces = [F.xxhash64(F.slice("m", at[j] + 1, at[j + 1] - at[j])).alias(f"p{j}") for j in range(PIECES)]
    hashed = tokens.select(*kept, "words", constants.alias("constants"), F.xxhash64("words", "m").alias("whole"), "marks", *pieces)
    need = F.lit(None).cast("int")
    for least, texts in reversed(LEAST):
        need = F.when(F.col("words") >= least, texts).otherwise(need)
    need = F.when((F.col("constants") > 0) & (F.col("constants") * 2 >= F.col("words")), need)
    fields = [F.xxhash64("words", *[F.lit("<*>") if j in (v, v + 1) else F.col(f"p{j}") for j in range(PIECES)]) for v in range(PIECES - 1)]
    keys = F.when(F.col("words") >= FIELD, F.array(*fields)).when(F.col("words") > 0, F.array("whole"))
    return hashed.select(*kept, "words", need.alias("need"), keys.alias("keys"), F.when(F.col("words") > 0, F.col("marks")).alias("marks"))


def recurring_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(t, t2, text), t and t2 hashes of the text -> (t, t2, drop): where the recurring lines of each distinct text
    are, and (t, n): how many rows each text has."""
    split = docs.where("text is not null").select("t", "t2", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    lines = materialize(parsed_lines(split).where((F.col("words") > 0) | (F.col("i") == 0)), "line-keys")
    each = lines.select("t", "t2", "i", "need", F.explode("keys").alias("k"))
    # Equal texts are one: they have one t.
    counts = each.groupBy("k").agg(F.min("t").alias("one"), F.max("t").alias("other"), F.count("*").alias("n"))
    shared = materialize(counts.where("one <> other").select("k", "n"), "line-shared")
    keys = lines.agg(F.sum(F.size("keys"))).first()[0] or 0
    hot = hot_keys(shared, "k", keys)
    met = materialize(spread_join(each, shared.select("k"), "k", hot, F.xxhash64("t", "i")).dropDuplicates(["t", "t2", "i", "k"]), "line-met")
    # Equal texts count as often on both sides of the comparison, so they need not be told apart.
    passages = lines.select("t", F.explode("marks").alias("z")).groupBy("z.mark").agg(F.min("t").alias("t"), F.max("t").alias("other"), F.sum("z.size").alias("size"))
    own = passages.where("t = other").groupBy("t").agg(F.sum("size").alias("own"))
    total = F.sum(F.coalesce(F.aggregate("marks", F.lit(0).cast("long"), lambda n, x: n + x["size"]), F.lit(0)))
    texts = lines.groupBy("t").agg(total.alias("size"), F.sum((F.col("i") == 0).cast("long")).alias("n"))
    texts = materialize(texts.join(own, "t", "left"), "line-texts")
    apart = texts.where("own * 5 > size * 2").select("t")
    counted = met.where("need is not null").join(apart, "t", "left_semi").select("k", "need", "t").distinct()
    found = counted.groupBy("k", "need").agg(F.count("*").alias("texts")).where("texts >= need").select("k").distinct()
    dropped = spread_join(met.where("need is not null"), found, "k", hot, F.xxhash64("t", "i"))
    flags = materialize(dropped.groupBy("t", "t2").agg(F.collect_set("i").alias("drop")), "line-drops")
    forget(lines, shared, met)
    return flags, texts.select("t", "n")


def drop_boilerplate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with recurring lines taken out of text_col, and n_lines and n_dropped beside (0 and 0 for a null text).

    A text without recurring lines is returned as it is; one of nothing else becomes empty. Null and empty texts,
    repeated rows and null ids stay rows; other columns are kept, whatever their names, but columns named n_lines or
    n_dropped are replaced. An empty input gives an empty result. Blank lines stay. Lines of any length are compared
    whole.
    """
    text = F.col(text_col)
    others = docs.drop(text_col)
    keyed = docs.select(whole_row(others).alias("row"), text.alias("text"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("t2"))
    flags, rows = recurring_lines(keyed.select("t", "t2", "text"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    flags = flags.withColumnRenamed("t2", "other")
    # The two hashes together tell texts apart; t alone deals them.
    hot = hot_keys(rows, "t", total)
    grouped = flags.groupBy("t").agg(F.collect_list(F.struct("other", "drop")).alias("known"))
    joined = spread_join(keyed, grouped, "t", hot, F.monotonically_increasing_id(), "left")
    drop = F.try_element_at(F.filter("known", lambda x: x["other"] == F.col("t2")), F.lit(1))["drop"]
    joined = joined.select("row", "text", F.when(F.col("text").isNotNull(), drop).alias("drop"))
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("drop", i))
    total = F.length(blank(F.col("text"))) - F.length(F.replace(blank(F.col("text")), F.lit("\n"))) + 1
    made = {
        text_col: F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(total).cast("long"),
        "n_dropped": F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long"),
    }
    out = unfold(joined, "row", others.schema, made)
    return out.select(*quoted(docs.drop("n_lines", "n_dropped")), "n_lines", "n_dropped")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its recurring lines dropped; null texts stay null, empty and repeated ones stay rows."""
    return drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_OP4 = r"""
WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT text, i, regexp_extract_all(l[i], '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT text, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM texts)),
masked AS (
  SELECT text, i, len(w) AS n, list_transform(w, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS m,
         len(list_filter(w, lambda t: regexp_matches(t, '[A-Za-z]|[^\x00-\x7F]') AND NOT regexp_matches(t, '[0-9]'))) AS constants
  FROM lines WHERE len(w) > 0),
pieces AS (
  SELECT text, i, n, m, list_transform(range(0, 8), lambda j: array_to_string(m[(n * j // 8) + 1 : n * (j + 1) // 8], ' ')) AS p,
         CASE WHEN constants > 0 AND constants * 2 >= n THEN CASE WHEN n >= 8 THEN 3 WHEN n >= 4 THEN 5 ELSE 10 END END AS need
  FROM masked),
keyed AS (
  SELECT text, i, n, need, unnest(CASE WHEN n >= 4 THEN list_transform(range(0, 7), lambda v:
           n || chr(10) || array_to_string(list_transform(range(0, 8), lambda j: CASE WHEN j = v OR j = v + 1 THEN '<*>' ELSE p[j + 1] END), chr(10)))
         ELSE [n || chr(10) || array_to_string(m, ' ')] END) AS k
  FROM pieces),
shared AS (SELECT k FROM keyed GROUP BY k HAVING min(text) <> max(text)),
met AS (SELECT DISTINCT text, i, n, need, k FROM keyed SEMI JOIN shared USING (k)),
marks AS (
  SELECT text, mark, length(mark) AS size
  FROM (SELECT text, unnest(string_split(regexp_replace(line, ' ([lnpwLNPW])', chr(10) || '\1', 'g'), chr(10))) AS mark
        FROM (SELECT text, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]'))
  WHERE length(mark) >= 20),
own AS (SELECT min(text) AS text, sum(size) AS n FROM marks GROUP BY mark HAVING min(text) = max(text)),
apart AS (
  SELECT text FROM (SELECT text, sum(size) AS size FROM marks GROUP BY text) JOIN (SELECT text, sum(n) AS own FROM own GROUP BY text) USING (text)
  WHERE own * 5 > size * 2),
found AS (
  SELECT k FROM (SELECT DISTINCT k, need, text FROM met SEMI JOIN apart USING (text) WHERE need IS NOT NULL)
  GROUP BY k, need HAVING count(*) >= need),
dropped AS (SELECT text, list(DISTINCT i) AS drop FROM met SEMI JOIN found USING (k) WHERE need IS NOT NULL GROUP BY text),
split AS (SELECT doc_id, d.text, string_split(d.text, chr(10)) AS l, coalesce(drop, []) AS drop FROM documents d LEFT JOIN dropped USING (text) WHERE d.text IS NOT NULL)
SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(drop, i)), lambda i: l[i]), chr(10)) AS text,
       len(l)::BIGINT AS n_lines, len(drop)::BIGINT AS n_dropped
FROM split
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""
