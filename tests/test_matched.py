"""Match queries on inputs that the given tables don't hold."""

from pathlib import Path

import numpy as np
from oracle import spark_rows, sql_rows

from foliant.functions import similarity
from foliant.operators import matching
from foliant.plans.registry import ORACLES, QUERIES


def with_documents(spark, sf_dir, folder, texts):
    """A folder of tables like sf_dir, with documents of these texts."""
    for p in Path(sf_dir).glob("*.parquet"):
        if p.name != "documents.parquet":
            (folder / p.name).symlink_to(p)
    rows = [(10 * i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).toPandas().to_parquet(folder / "documents.parquet")
    return str(folder)


def test_exact_match_of_other_than_ascii(spark, sf_dir, tmp_path):
    texts = ["Σοφος ΝΕΟΣ x one two", "σοφοσ νεοσ x one two", "İzmir a b one two", "izmir a b one two", "an inégal b c one two", "an égal b c one two", "réa b c one two", "ré b c one two"]
    texts += ["p\x0bq r s one two", "p q r s one two", "p q r one\xa0two s", "p q r one two s", "p q r s\xa0", "p q r s", "u v w x\x85y", "u v w x y", "  lead a b c", "", None]
    folder = with_documents(spark, sf_dir, tmp_path, texts)
    got = spark_rows(QUERIES["exact_match"](spark, folder))
    assert got == sql_rows(ORACLES["exact_match"], folder)
    assert len(got[1]) > len(texts)


def test_indel_pairs_are_all(spark):
    draw = np.random.default_rng(3)
    strings = sorted({"".join(draw.choice(list("ab c")[: 2 + i % 3], draw.integers(1, 9 if i % 2 else 16))) for i in range(260)})
    left, right = strings[::2] + strings[:20], strings[1::2] + strings[:40]
    for least in (0.8, 0.6):
        df = lambda x, c: spark.createDataFrame([(s,) for s in x], f"{c} string")
        got = {(r.a, r.b): r.ratio for r in matching.indel_pairs(df(left, "a"), df(right, "b"), "a", "b", least).collect()}
        want = {(x, y): similarity.indel_of(x, y) for x in left for y in right if similarity.indel_of(x, y) >= least - 1e-9}
        assert got == want and len(want) > 100


def test_copies_make_no_pairs(spark):
    copies = 3000
    rows = [(i, "anna miller", ("winter rose", "winter roses")[i % 2]) for i in range(copies)] + [(copies, None, "x")]
    e, b = spark.createDataFrame(rows, "ext_id int, author string, title string"), spark.createDataFrame(rows, "work_id int, author string, title string")
    fuzzy = matching.fuzzy_matches(e, b)
    assert {r.ext_id: r.work_id for r in fuzzy.collect()} == {i: 1 - i % 2 for i in range(copies)}
    made = matching.counted_matches(e, b)
    assert made.count() == 2 * copies
    report = matching.match_report(made, e).first()
    assert (report.total, report.exact, report.fuzzy, report.matched, report.n_rows) == (copies * copies // 2 + copies, copies * copies // 2, copies, copies, copies + 1)
