"""Printed reports read back from positioned text, by hand."""

import pytest

from contestlab.sources import positioned as P

HEAD = [(10, 40, "Game Date"), (60, 41, "Game Time"), (110, 40, "Matchup"), (160, 40, "Team"), (220, 42, "Player Name"), (300, 40, "Current Status"), (360, 40, "Reason")]
FIRST = [(5, 12, "Injury Report: 03/09/26 12:15 AM"), *HEAD,
         (10, 80, "03/09/2026"), (60, 80, "07:00"), (85, 82.4, "(ET)"), (110, 80, "AA@BB"), (160, 80, "Town Foxes"), (221, 81, "Roe, Jo"), (300, 80, "Out"),
         (360, 72, "Illness; Two-"), (360, 88, "Way deal"),
         (220, 110, "Poe, Al"), (300, 112, "Probable"), (360, 95, "halfway"), (360, 110, "Rest"),
         (160, 140, "Lake Owls"), (360, 140, "NOT YET SUBMITTED"), (110, 180, "CC@DD"), (300, 240, "Page 1 of 2")]
SECOND = [(360, 20, "of the team"), (110, 80, "EE@FF"), (160, 80, "Bay Cats"), (220, 80, "Doe, Di"), (300, 80, "Out"), (360, 80, "Knee"), (5, 12, "Injury Report: 03/09/26 12:15 AM"), (300, 240, "Page 2 of 2")]
WANT = [
    (1, 1, "2026-03-09", "AA@BB", "Town Foxes", "Roe, Jo", "Out", "Illness; Two-Way deal halfway", None),
    (1, 2, "2026-03-09", "AA@BB", "Town Foxes", "Poe, Al", "Probable", "Rest", None),
    (1, 3, "2026-03-09", "AA@BB", "Lake Owls", None, None, "NOT YET SUBMITTED of the team", None),
    (2, 4, "2026-03-09", "EE@FF", "Bay Cats", "Doe, Di", "Out", "Knee", None),
]


def items(spark, pages, sideways=False, report="r"):
    rows = []
    for page, tokens in enumerate(pages, 1):
        for i, (along, down, text) in enumerate(tokens):
            x, y = (down, along) if sideways else (along, -down)
            rows.append((report, page, i, float(x), float(y), text))
    return spark.createDataFrame(rows, "report string, page int, item int, x double, y double, text string")


def read(df):
    return [tuple(r)[2:] for r in sorted(P.report_rows(df).collect(), key=lambda r: (r.report, r.nth))]


def test_upright_and_sideways_alike(spark):
    """A matchup below a page's last row is carried nowhere; of two rows as near, the upper one has the line."""
    upright, sideways = (items(spark, [FIRST, [*SECOND, (400, 60, "  ")]], turn, str(turn)) for turn in (False, True))
    both = P.report_rows(upright.union(sideways)).collect()
    for report in ("False", "True"):
        rows = sorted((r for r in both if r.report == report), key=lambda r: r.nth)
        assert [tuple(r)[2:] for r in rows] == WANT and {r.issued for r in rows} == {"2026-03-09T00:15"}


@pytest.mark.parametrize(
    "old, new, issue",
    [("Out", "Maybe", "no valid status"), ("Roe, Jo", "Roe Jo", "no family name"), ("AA@BB", "AA-BB", "bad matchup"), ("03/09/2026", "3/9/26", "bad date"), ("AA@BB", " ", "no date, matchup or team"),
     ("Injury Report: 03/09/26 12:15 AM", "Report", "no stamp")],
)
def test_unsound_rows_say_why(spark, old, new, issue):
    page = [(a, d, new if t == old else t) for a, d, t in FIRST]
    assert read(items(spark, [page]))[0][-1] == issue


def test_no_header_and_no_rows(spark):
    assert read(items(spark, [[t for t in FIRST if t not in HEAD]])) == []
    assert read(items(spark, [HEAD])) == []
    assert read(items(spark, [FIRST]).where("false")) == []
