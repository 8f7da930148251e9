import random

import tempolyra.llm.line_dedup as line_dedup
from tempolyra.llm.line_dedup import drop_recurring_lines, recurring_lines
from tempolyra.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for k in range(30):  # a footer with a number, and one that is the same everywhere
        rows.append((k, f"{prose(20)}\n{prose(12)}\nPage {k} of {k + 7} printed\n{prose(15)}\nAll rights reserved here"))
    body = [prose(15) for _ in range(8)]
    for k in range(100, 140):  # copies and near copies of one document
        lines = list(body)
        if k % 2:
            w = lines[k % 8].split()
            w[9] = "changed"
            lines[k % 8] = " ".join(w)
        rows.append((k, "\n".join(lines)))
    return rows


def test_footers_go_and_bodies_stay(spark):
    rows = corpus()
    got = {r.doc_id: r for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = "\n".join(x for x in t.split("\n") if not x.startswith(("Page", "All rights")))
        assert got[i].text == want
        assert got[i]["__dropped"] == (2 if i < 100 else 0)


def test_footer_of_a_hot_document(spark):
    """A document copied often, some copies edited, with a footer that others have too: the footer goes from
    all of them, the body stays."""
    rng = random.Random(9)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(9))
    body, footer = [prose() for _ in range(12)], "Printed on recycled paper only"
    rows = [(k, "\n".join([prose(), prose(), footer])) for k in range(30)]
    for k in range(100, 700):
        lines = list(body)
        if k % 3 == 0:
            lines[k % 12] = prose()
        rows.append((k, "\n".join([*lines, footer])))
    got = {r.doc_id: r.text for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == t.removesuffix("\n" + footer)


def test_pages_of_few_lines(spark):
    """Different pages lose header, navigation and footer, also where these are most of their lines; copies and
    edited copies of one page keep its body, however many they are."""
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(9))
    head, nav, foot = "Welcome to our pages", "Home News About Contact", "All rights reserved here"
    rows, want = [], {}
    for top, bottom, n in (([head], [foot], 1), ([head, nav], [foot], 1), ([head, nav], [foot], 2), ([head], [foot], 6)):
        for _ in range(60):
            body = [prose() for _ in range(n)]
            want[len(rows)] = "\n".join(body)
            rows.append((len(rows), "\n".join([*top, *body, *bottom])))
    body = [prose() for _ in range(9)]
    for k in range(400):
        lines = list(body)
        for j in range(k % 3):
            lines[(k + 4 * j) % 9] = prose()
        want[len(rows)] = "\n".join(lines)
        rows.append((len(rows), "\n".join([head, *lines, foot])))
    got = {r.doc_id: r.text for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_lines_of_unlike_texts_go(spark):
    """Of the lines that stand in five or more texts that hardly meet otherwise, nearly all go."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: set(r.text.split("\n")) for r in drop_recurring_lines(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("text is not null").collect()}
    where = {}
    for i, t in rows:
        for x in {x for x in t.split("\n") if len(x.split()) >= 3}:
            where.setdefault(x, {}).setdefault(t, i)
    others = {t: set(t.split("\n")) for _, t in rows}
    found = left = 0
    for x, texts in where.items():
        unlike = []
        for t in texts:
            if all(len(others[t] & others[u]) * 2 <= min(len(others[t]), len(others[u])) for u in unlike):
                unlike.append(t)
        if len(unlike) >= 5:
            found += 1
            left += any(x in got[i] for i in texts.values())
    assert found >= 20 and left <= found * 0.05, (found, left)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "\n\n", 3), (None, "a b c", 4), (5, "a b c", 5), (5, "a b c", 5), (6, "x " * 30000, 6)]
    rows += [(k, "one two three\n" + " ".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz"[k - 8 : k - 4]), 0) for k in range(10, 20)] + [(10, "one two three\nother words here", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos int")
    for name in ("__row", "__bits", "__bucket", "__maybe", "row", "doc", "gone", "ID2"):
        clash = drop_recurring_lines(df.withColumnRenamed("pos", name))
        assert sorted(r[name] for r in clash.collect()) == sorted(p for *_, p in rows)
    got = drop_recurring_lines(df)
    assert got.columns == [*df.columns, "__dropped"]
    out = sorted(((r.doc_id, r.text, r.pos) for r in got.collect()), key=repr)
    cut = lambda t: "\n".join(x for x in t.split("\n") if x != "one two three") if t else t
    assert out == sorted(((i, cut(t), p) for i, t, p in rows), key=repr)
    assert drop_recurring_lines(df.limit(0)).count() == 0


def test_oracle(spark):
    compare(QUERIES["op7_line_dedup"](spark, SF), ORACLES["op7_line_dedup"], SF)


def test_texts_move_once(spark, monkeypatch):
    """The texts of recurring lines are shuffled once for repeats and join, and token rows carry no columns of their line."""
    plans = {}

    def cut(df, label, **options):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label, **options)

    real = line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", cut)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        recurring_lines(spark.createDataFrame(corpus(), "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans["near-tokens"].count("Exchange hashpartitioning") == 2
    grouped = [x for x in plans["templates"].splitlines() if "collect_list" in x]
    assert grouped and not any("row_hash" in x for x in grouped)


def test_templates(spark):
    """Tokens that stay keep their places, whatever varies before, between and after them; repeats of a row and
    null ids count once."""
    rows = [(k if k else None, f"alpha beta gamma x{'abcdefgh'[k]}y delta epsilon {k} zeta q{'abcdefgh'[k]}\n{'abcdefgh'[k] * 5} {'hgfedcba'[k] * 4} own words only") for k in range(8)]
    got = recurring_lines(spark.createDataFrame(rows + rows[:2], "doc_id long, text string")).collect()
    assert sorted((r.id is None, r.id, r.pos, r.template) for r in got if r.id is not None) == [(False, k, 0, "alpha beta gamma <*> delta epsilon <*> zeta <*>") for k in range(1, 8)]
    assert {(r.pos, r.template) for r in got if r.id is None} == {(0, "alpha beta gamma <*> delta epsilon <*> zeta <*>")}
    assert len(got) == 8
