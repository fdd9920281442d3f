import re
from collections import Counter

import duckdb

from countspark.llm import queries


def norm(s):
    return re.sub(r"\s+", " ", s.lower()).strip(" ")


def paragraphs(lines):
    return re.split(r"\n[ \t\r]*\n", "\n".join(lines))


def slow(rows):
    own, quotes = {}, {}
    for c, t, _, text in rows:
        lines = re.split(r"\r?\n", text or "")
        mine = [x for x in lines if not re.match(r"[ \t]*>", x)]
        own.setdefault((c, t), []).append(mine)
        found, last = [], None
        for at, x in enumerate(lines):
            m = re.match(r"(?:[ \t]*>)+", x)
            if m:
                level = m[0].count(">")
                if last != (at - 1, level):
                    found.append((level, []))
                found[-1][1].append(x[m.end() :])
                last = (at, level)
        quotes.setdefault((c, t), []).extend(found)
    parents = {}
    for (c, t), found in quotes.items():
        votes = Counter()
        for level, lines in found:
            several = paragraphs(lines) if len(paragraphs(lines)) > 1 else []
            for said, weight in [(norm(" ".join(lines)), len(lines) + 1), *((norm(x), x.count("\n") + 2) for x in several), *((norm(x), 1) for x in lines)]:
                if not said:
                    continue
                holders = [u for (d, u), parts in own.items() if d == c and any(said in {norm(x) for x in mine + paragraphs(mine)} | {norm(" ".join(mine))} for mine in parts)]
                if holders and min(holders) < t:
                    votes[level, min(holders)] += weight
        if votes:
            parents[c, t] = max(votes, key=lambda k: (-k[0], votes[k], -k[1]))[1]
    out = []
    for c, t, role, text in rows:
        root, depth = t, 0
        while (c, root) in parents:
            root, depth = parents[c, root], depth + 1
        lines = re.split(r"\r?\n", text or "")
        n = sum(bool(re.match(r"[ \t]*>", x)) for x in lines)
        clean = text if not n else "\n".join(x for x in lines if not re.match(r"[ \t]*>", x)).strip()
        out.append((c, t, role, clean, n, parents.get((c, t)), root, depth))
    return out


ROWS = [
    (1, 0, "user", "Hello there.\nHow are you?"),
    (1, 1, "assistant", "> Hello   there.\n> How are you?\nFine, thanks."),
    (1, 2, "user", ">> Hello there.\n>> How are you?\n> fine, thanks.\nGood to hear."),
    (1, 3, "user", "> How are you?\n\nI am well too."),
    (1, 4, "user", "> never said\nStray quote"),
    (1, 5, "assistant", " > Good to hear.\n\n > I am well too.\r\nYes"),
    (2, 0, "user", "Yes"),
    (2, 1, "user", "> Yes"),
    (2, 1, "user", "more of it"),
    (3, 0, "system", None),
    (3, 1, "user", ""),
    (3, 2, "user", "> "),
    (4, 0, "user", "x " * 60000),
    (4, 1, "user", "> " + "x " * 60000 + "\nlong"),
    (5, 0, "user", "one two\nthree four\n\nfive six\nseven\n \n\neight nine"),
    (5, 1, "user", "> one two three\n> four\nA paragraph with other line breaks."),
    (5, 2, "user", "> five\n> six seven\n>\n> A paragraph with\n> other line breaks.\nBoth"),
    (6, 0, "user", "a b c"),
    (6, 1, "user", "> a\n> b\n> c"),
    (6, 1, "user", "> a\n> b\n> c"),
    (6, 2, "user", "other"),
    (6, 3, "user", "> a b c\n> other"),
    (6, 3, "user", "> a b c\n> other"),
    (6, 3, "user", "> other"),
] + [(9, k, "user", (f"> message {k - 1}\n" if k else "") + f"message {k}") for k in range(40)]


def test_query(spark, tmp_path):
    rows = [(*r, "clash") for r in ROWS]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in queries.op4_quotes(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(slow(ROWS))
    assert [(r[0], r[6], r[7], r[1]) for r in got] == sorted((r[0], r[6], r[7], r[1]) for r in got)
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = db.sql(f"select conv_id, turn, role, text, n_quoted_lines, parent_turn, root_turn, depth from ({queries.oracle_sql()['op4_quotes']})").fetchall()
    assert Counter(want) == Counter(got)


def test_nulls_and_empty(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(None, 1, None, "> a"), (1, None, None, "a"), (None, None, None, None), (1, 1, "user", "> a")], schema).write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = queries.op4_quotes(spark, f"{tmp_path}/a").collect()
    assert len(got) == 4 and all(r.parent_turn is None for r in got)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert queries.op4_quotes(spark, f"{tmp_path}/b").count() == 0


def test_repeated_rows_and_paragraphs_find_their_parents(spark, tmp_path):
    spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.parent_turn for r in queries.op4_quotes(spark, str(tmp_path)).collect()}
    assert (got[6, 1], got[5, 1], got[5, 2]) == (0, 0, 0)
