"""Tables read from positioned text: rows (report, page, item, x, y, text) of a printed report, one for each fragment.

The reports are many and a page is small, so everything is grouped or windowed by report and page: which way a page is
turned, where its header's columns start, which fragments are one line, and which row a wrapped cell belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.session import cut_lineage

# Fixed values of the printed report: its columns in order, how each one's heading begins, its words and tolerances.
COLUMNS = ("date", "time", "matchup", "team", "player", "status", "reason")
HEADINGS = {"matchup": "Matchup", "team": "Team", "player": "Player", "status": "Current", "reason": "Reason"}
STATUSES = ("Available", "Probable", "Questionable", "Doubtful", "Out")
NOT_SUBMITTED = "NOT YET SUBMITTED"
TITLE = "Injury Report:"
FOOTER = r"^Page \d+ of \d+$"
SAME_LINE, SAME_ROW, LONE_ROW = 2.5, 3.0, 20.0

PAGE = ("report", "page")


def _first(value: str, where: Column, order: Column) -> Column:
    """value of the first row by order for which `where` holds, in an aggregate."""
    return F.min_by(value, F.when(where, order))


def turned(items: DataFrame) -> DataFrame:
    """items -> (report, page, item, text, along, down, headed): down the page whichever way it is turned.

    A page is rotated if its Matchup and Reason headings are further apart in y than in x; a page without them is turned
    as the one before it. Blank fragments, and pages before any with headings, are left out."""
    clean = items.select(*PAGE, "item", F.trim("text").alias("text"), "x", "y").where("text <> ''")
    heading, reason = F.col("text").startswith("Matchup"), F.col("text") == "Reason"
    pages = clean.groupBy(*PAGE).agg(*[_first(c, w, F.col("item")).alias(f"{c}_{n}") for n, w in (("m", heading), ("r", reason)) for c in "xy"])
    mine = F.abs(F.col("x_m") - F.col("x_r")) < F.abs(F.col("y_m") - F.col("y_r"))
    so_far = Window.partitionBy("report").orderBy("page")
    pages = pages.select(*PAGE, F.last(mine, ignorenulls=True).over(so_far).alias("rotated")).where("rotated is not null")
    rotated = F.col("rotated")
    along, down = F.when(rotated, F.col("y")).otherwise(F.col("x")), F.when(rotated, F.col("x")).otherwise(-F.col("y"))
    return clean.join(pages, [*PAGE]).select(*PAGE, "item", "text", along.alias("along"), down.alias("down"))


def lines(tokens: DataFrame, *by: str) -> DataFrame:
    """tokens(report, page, *by, item, along, down, text) -> (report, page, *by, down, text): fragments joined to lines,
    left to right. From the top, a line takes all that begins less than SAME_LINE below its first fragment."""
    group = [*PAGE, *by]
    starts = F.aggregate(
        F.array_sort(F.collect_set("down")), F.array().cast("array<double>"),
        lambda known, d: F.when((F.size(known) > 0) & (F.abs(F.element_at(known, -1) - d) < SAME_LINE), known).otherwise(F.concat(known, F.array(d))),
    )
    pages = tokens.groupBy(*group).agg(starts.alias("starts"), F.array_sort(F.collect_list(F.struct("along", "item", "down", "text"))).alias("parts"))

    def line(start: Column, i: Column) -> Column:
        after = F.coalesce(F.try_element_at("starts", i + 2), F.lit(float("inf")))
        own = F.filter("parts", lambda t: (t["down"] >= start) & (t["down"] < after))
        return F.struct(start.alias("down"), F.array_join(F.transform(own, lambda t: t["text"]), " ").alias("text"))

    return pages.select(*group, F.inline(F.transform("starts", line)))


def located(tokens: DataFrame) -> DataFrame:
    """(report, page, header_down, starts): where each column starts, from the page's header row or the last one before
    it; header_down is null on a page without a header of its own."""
    first = Window.partitionBy(*PAGE)
    matchup = F.min_by("down", F.when(F.col("text").startswith("Matchup"), F.col("item"))).over(first)
    header = tokens.withColumn("header_down", matchup).where(F.abs(F.col("down") - F.col("header_down")) < SAME_ROW)
    nth = F.row_number().over(Window.partitionBy(*PAGE, F.col("text").startswith("Game")).orderBy("along", "item"))
    game = lambda n: F.min(F.when(F.col("text").startswith("Game") & (F.col("nth") == n), F.col("along")))
    found = [game(1).alias("date"), game(2).alias("time")] + [F.min(F.when(F.col("text").startswith(h), F.col("along"))).alias(c) for c, h in HEADINGS.items()]
    header = header.withColumn("nth", nth).groupBy(*PAGE).agg(F.first("header_down").alias("header_down"), *found)
    pages = tokens.select(*PAGE).distinct().join(header, [*PAGE], "left")
    whole = F.when(F.forall(F.array(*COLUMNS), lambda c: c.isNotNull()), F.struct(*COLUMNS))
    return pages.select(*PAGE, "header_down", F.last(whole, ignorenulls=True).over(Window.partitionBy("report").orderBy("page")).alias("starts"))


def _latest(lines_: DataFrame, anchors: DataFrame, name: str) -> DataFrame:
    """anchors with the text of the page's last line at or above each (SAME_ROW of slack), else of the row before it."""
    own = lines_.select(*PAGE, F.col("down").alias("at"), F.lit(0).alias("kind"), F.col("text").alias(name), *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in anchors.columns if c not in PAGE])
    rows = anchors.select(*PAGE, (F.col("down") + SAME_ROW).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias(name), *[c for c in anchors.columns if c not in PAGE])
    here = Window.partitionBy(*PAGE).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    known = own.unionByName(rows).withColumn(name, F.last(name, ignorenulls=True).over(here)).where("kind = 1").drop("at", "kind")
    return known.withColumn(name, F.last(name, ignorenulls=True).over(Window.partitionBy("report").orderBy("page", "down", "player")))


def report_rows(items: DataFrame) -> DataFrame:
    """items(report, page, item, x, y, text) -> (report, issued, page, nth, game_date, matchup, team, player, status, reason,
    issue): a row for each listed player and each team that has not submitted, nth in the order of the report.

    A row is anchored on its player, or on the words of a missing submission. A date, matchup or team stands for all rows
    until the next one, over page ends too. A wrapped reason is centred on its row, so each of its lines goes to the nearest
    row, the upper one of two; lines a row's height above a page's first row go on with the last row of the pages before.
    issue says what a row lacks, and is null for a sound one; a report without a header has no rows.
    """
    tokens = cut_lineage(turned(items))  # fragments, cells and rows are each read several times below
    where = located(tokens).where("starts is not null")
    every = lines(tokens)
    stamp = rf"{TITLE}\s*(\d\d)/(\d\d)/(\d\d)\s+(\d\d):(\d\d)\s*(AM|PM)"
    part = lambda i: F.regexp_extract("text", stamp, i)
    hour = part(4).try_cast("int") % 12 + F.when(part(6) == "PM", 12).otherwise(0)
    issued = F.format_string("20%s-%s-%sT%02d:%s", part(3), part(1), part(2), hour, part(5))
    titles = every.where(F.col("text").rlike(stamp)).groupBy("report").agg(F.min_by(issued, F.struct("page", "down")).alias("issued"))

    below = tokens.join(where, [*PAGE]).where((F.col("header_down").isNull()) | (F.col("down") > F.col("header_down") + SAME_ROW))
    furniture = lines(below.select(*PAGE, "item", "text", "along", "down")).where(F.col("text").rlike(FOOTER) | F.col("text").startswith(TITLE))
    furniture = furniture.groupBy(*PAGE).agg(F.collect_list("down").alias("furniture"))
    body = below.join(furniture, [*PAGE], "left")
    body = body.where(F.forall(F.coalesce("furniture", F.array().cast("array<double>")), lambda d: F.abs(F.col("down") - d) >= SAME_LINE))
    column = F.lit("date")
    for c in COLUMNS:
        column = F.when(F.col("along") >= F.col("starts")[c] - SAME_ROW, F.lit(c)).otherwise(column)
    cells = cut_lineage(lines(body.select(*PAGE, column.alias("column"), "item", "text", "along", "down"), "column"))
    of = lambda c: cells.where(F.col("column") == c).select(*PAGE, "down", "text")

    # A player's status is the page's first status line within SAME_ROW of it: of a page's few lines.
    statuses = of("status").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("down", "text"))).alias("statuses"))
    near = F.try_element_at(F.filter("statuses", lambda s: F.abs(s["down"] - F.col("down")) < SAME_ROW), F.lit(1))["text"]
    players = of("player").join(statuses, [*PAGE], "left").select(*PAGE, "down", F.col("text").alias("player"), near.alias("status"))
    missing = F.col("text").contains(NOT_SUBMITTED)
    text = F.lit(None).cast("string")
    anchors = players.union(of("reason").where(missing).select(*PAGE, "down", text, text))
    for name in ("date", "matchup", "team"):
        anchors = _latest(of(name), anchors, name)
    in_order = Window.partitionBy("report").orderBy("page", "down", "player")
    anchors = cut_lineage(anchors.withColumn("nth", F.row_number().over(in_order)))

    # Each reason line between the rows above and below it; row heights are the least distance of two rows of a page.
    on_page = Window.partitionBy(*PAGE).orderBy("down", "nth")
    gaps = anchors.withColumn("gap", F.col("down") - F.lag("down").over(on_page)).groupBy(*PAGE).agg(F.min("down").alias("top"), F.coalesce(F.min("gap"), F.lit(LONE_ROW)).alias("height"), F.min("nth").alias("first"))
    marks = anchors.select(*PAGE, "down", F.col("nth").alias("row"), F.col("down").alias("place"), text.alias("text"))
    rest = of("reason").where(~missing).select(*PAGE, "down", F.lit(None).cast("int").alias("row"), F.lit(None).cast("double").alias("place"), "text")
    both = marks.union(rest)
    upto = Window.partitionBy(*PAGE).orderBy("down", F.col("row").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*PAGE).orderBy("down", F.col("row").isNull()).rowsBetween(0, Window.unboundedFollowing)
    above, under = (lambda f, w: (f("row", ignorenulls=True).over(w), f("place", ignorenulls=True).over(w)))(F.last, upto), (F.first("row", ignorenulls=True).over(after), F.first("place", ignorenulls=True).over(after))
    spread = both.select(*PAGE, "down", "row", "text", above[0].alias("up"), above[1].alias("up_at"), under[0].alias("low"), under[1].alias("low_at")).where("row is null").drop("row")
    nearer = F.col("up").isNotNull() & (F.col("low").isNull() | (F.col("down") - F.col("up_at") <= F.col("low_at") - F.col("down")))
    spread = spread.join(gaps, [*PAGE], "left")
    goes_on = F.col("top").isNull() | (F.col("down") < F.col("top") - F.col("height"))
    # A page without rows goes on with the last row of the pages before: that with the most rows counted so far.
    counted = spread.select(*PAGE).union(anchors.select(*PAGE)).distinct().join(anchors.groupBy(*PAGE).agg(F.count("*").alias("n")), [*PAGE], "left")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("report").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = spread.join(counted.select(*PAGE, earlier.cast("int").alias("before")), [*PAGE])
    owned = spread.select("report", F.when(goes_on, F.col("before")).when(nearer, F.col("up")).otherwise(F.col("low")).alias("nth"), goes_on.alias("later"), "page", "down", "text")
    listed = owned.groupBy("report", "nth").agg(F.array_sort(F.collect_list(F.struct("later", "page", "down", "text"))).alias("parts"))
    told = lambda later: F.array_join(F.transform(F.filter("parts", lambda p: p["later"] == later), lambda p: p["text"]), " ")
    listed = listed.select("report", "nth", told(F.lit(False)).alias("own"), told(F.lit(True)).alias("more"))

    none = F.col("player").isNull()
    rows = anchors.join(listed, ["report", "nth"], "left").join(titles, "report", "left")
    own = F.trim(F.concat_ws(" ", F.when(none, F.lit(NOT_SUBMITTED)), F.when(F.col("own") != "", F.col("own"))))
    reason = F.trim(F.concat_ws(" ", F.regexp_replace(own, r"(\w)- (\w)", "$1-$2"), F.when(F.col("more") != "", F.col("more"))))
    date = F.regexp_replace("date", r"^(\d\d)/(\d\d)/(\d{4})$", "$3-$1-$2")
    issue = (
        F.when(F.col("issued").isNull(), "no stamp").when(~none & ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "no valid status").when(~none & ~F.col("player").contains(","), "no family name")
        .when(F.col("date").isNull() | F.col("matchup").isNull() | F.col("team").isNull(), "no date, matchup or team").when(~F.col("date").rlike(r"^\d\d/\d\d/\d{4}$"), "bad date").when(~F.col("matchup").rlike("^[A-Z]{2,3}@[A-Z]{2,3}$"), "bad matchup")
    )
    return rows.select("report", "issued", "page", "nth", date.alias("game_date"), "matchup", "team", "player", "status", reason.alias("reason"), issue.alias("issue"))
