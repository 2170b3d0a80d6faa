"""Operators that SQL can't express, or that write and read: against brute force, known values and round trips."""

import itertools
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import runners
from foliant.functions import clean, distributions, headers, similarity
from foliant.models import hybrid, search, topics
from foliant.operators import matching, quality, quantiles, sampling, sentences, stats, tagging, works
from foliant.plans import catalogue
from foliant.session import table
from foliant.sources import readers, sinks
from foliant.streaming import resume


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_string_similarities():
    draw = np.random.default_rng(1)
    words = ["".join(draw.choice(list("abcd"), draw.integers(0, 9))) for _ in range(120)]
    for a, b in itertools.islice(itertools.product(words, words), 0, None, 7):
        want = 0.0 if not a or not b else 2 * lcs(a, b) / (len(a) + len(b))
        assert similarity.indel_of(a, b) == pytest.approx(want)
    assert similarity.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.jaro_winkler_of("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert similarity.jaro_winkler_of("", "a") == 0 and similarity.jaro_winkler_of("a", "a") == 1
    assert [similarity.damerau_of(*p) for p in (("ca", "abc"), ("abcd", "acbd"), ("", "xy"), ("same", "same"))] == [2, 1, 2, 0]


def test_tail_probabilities():
    assert distributions.normal_p_of(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert distributions.chi2_p_of(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert distributions.chi2_p_of(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert distributions.chi2_p_of(0, 3) == 1 and distributions.chi2_p_of(1000, 2) < 1e-200
    assert distributions.t_p_of(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert distributions.t_p_of(0, 5) == pytest.approx(1)


def test_p_values_of_tests(spark):
    rows = spark.createDataFrame([(float(i % 7), i % 2) for i in range(300)], "x double, g int")
    got = stats.mann_whitney(rows.filter("g = 0"), rows.filter("g = 1"), "x").first()
    assert 0 < got.p <= 1 and got.p == pytest.approx(min(1, math.erfc(got.z / math.sqrt(2))), abs=1e-9)
    even = stats.independence(spark.createDataFrame([("a", "x", 50), ("a", "y", 50), ("b", "x", 50), ("b", "y", 50)], "a string, b string, n int"), "a", "b", "n").first()
    assert (even.chi2, even.dof, even.n, even.cramers_v, even.p) == (0, 1, 200, 0, 1)
    assert stats.mann_whitney(rows.limit(0), rows, "x").count() == 0


def test_quantiles_are_exact(spark):
    draw = np.random.default_rng(2)
    values = [float(x) for x in np.round(draw.lognormal(3, 2, 30_000), 2)] + [0.0] * 9000
    rows = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g int, v double").repartition(6)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = quantiles.quantiles(rows, ["v"], shares).first()
    assert [got[f"q{i}"] for i in range(len(shares))] == pytest.approx([np.quantile(values, s) for s in shares])
    for r in quantiles.quantiles(rows, ["v"], shares, ["g"]).collect():
        assert [r[f"q{i}"] for i in range(len(shares))] == pytest.approx([np.quantile(values[r.g :: 3], s) for s in shares])
    assert quantiles.quantiles(rows.limit(0), ["v"], [0.5]).count() == 0
    assert quantiles.quantile_row(rows.limit(0), "v", [0.5]).first()[0] is None


def test_running_counts(spark):
    draw = np.random.default_rng(3)
    counts = {(int(g), float(v)): int(n) for g, v, n in zip(draw.integers(0, 3, 4000), np.round(draw.normal(0, 50, 4000), 1), draw.integers(1, 9, 4000))}
    df = spark.createDataFrame([(*k, n) for k, n in counts.items()], "g int, v double, n int").repartition(5)
    for r in stats.running_counts(df, "v", "n", ["g"]).collect():
        assert r.below == sum(n for (g, v), n in counts.items() if g == r.g and v < r.v)
        assert r.total == sum(n for (g, _), n in counts.items() if g == r.g)


def test_power_law(spark):
    draw = np.random.default_rng(4)
    x = np.floor((5 - 0.5) * (1 - draw.random(3000)) ** (-1 / 1.5) + 0.5)
    x = np.concatenate([x, draw.integers(1, 5, 800)])
    got = stats.power_law(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()

    def zeta(s, q, scale):
        y = (q + np.arange(0, 20_001)) / scale
        return float((y[:-1] ** -s).sum() + y[-1] ** -s * ((q + 20_000) / (s - 1) + 0.5))

    kinds = np.unique(x)
    step = max(1, math.ceil(len(kinds) / 100))
    best = None
    for m in kinds[::step]:
        tail = np.sort(x[x >= m])
        alpha = 1 + len(tail) / np.log(tail / (m - 0.5)).sum()
        gaps = [abs((tail <= v).mean() - (1 - zeta(alpha, v + 1, m) / zeta(alpha, m, m))) for v in np.unique(tail)] if len(tail) else [1]
        if alpha > 1 and (best is None or max(gaps) < best[0]):
            best = (max(gaps), m, alpha, len(tail))
    assert (got.xmin, got.n_tail) == (best[1], best[3]) and got.alpha == pytest.approx(best[2]) and got.ks == pytest.approx(best[0], abs=1e-6)
    assert stats.power_law(spark.createDataFrame([(1.0,)], "x double"), "x").count() == 0


def test_fuzzy_matches_are_all(spark):
    draw = np.random.default_rng(5)
    first, last = ["anna", "annie", "hanna", "jon", "john", "joan"], ["miller", "muller", "mill", "smith", "smyth", "smithe"]
    titles = ["winter rose", "winter roses", "a winter rose", "summer tale", "summer tales", "dark hills"]
    pick = lambda n, shift: [(i + shift, f"{draw.choice(first)} {draw.choice(last)}", str(draw.choice(titles))) for i in range(n)]
    external, books = pick(40, 0) + [(900, None, "x"), (901, "", "y")], pick(60, 100) + [(990, None, None)]
    e, b = spark.createDataFrame(external, "ext_id int, author string, title string"), spark.createDataFrame(books, "work_id int, author string, title string")
    import re

    def key(x):
        x = re.sub(r"\s+", " ", (x or "").lower()).strip()
        x = re.sub(r"""[.,;:!?'"()\[\]{}]""", "", x)
        return re.sub(r"\s+", " ", re.sub(rf"\b({'|'.join(clean.KEY_WORDS)})\b", "", x)).strip()

    want, names = {}, sorted({key(a) for _, a, _ in books} - {""})
    for i, a, t in external:
        a, t = key(a), key(t)
        if not a or not t:
            continue
        near = sorted(((-similarity.indel_of(a, n), n) for n in names if similarity.indel_of(a, n) >= 0.8))[:10]
        found = []
        for s, n in near:
            for j, y, u in books:
                if key(y) == n and key(u) and (n, key(u)) != (a, t) and (ts := similarity.indel_of(t, key(u))) >= 0.8 and -s * 0.6 + ts * 0.4 >= 0.8:
                    found.append((s * 0.6 - ts * 0.4, j))
        if found:
            want[i] = min(found)
    got = {r.ext_id: (-r.confidence, r.work_id) for r in matching.fuzzy_matches(e, b).collect()}
    assert got.keys() == want.keys() and want
    assert all(got[i][1] == want[i][1] and got[i][0] == pytest.approx(want[i][0]) for i in want)
    report = matching.match_report(matching.all_matches(e, b), e).first()
    assert report.total == report.exact + report.fuzzy and report.n_rows == 42


def test_alias_candidates_are_all(spark):
    words = sorted({"".join(p) for p in itertools.product(["ro", "ra", "r"], ["mance", "mances", "mantic", "nge", "nch"], ["", "s", " a", "x"])})
    got = {(r.shelf_a, r.shelf_b): r.decision_hint for r in matching.alias_candidates(spark.createDataFrame([(w,) for w in words] * 2 + [("",), (None,)], "shelf_canon string")).collect()}
    want = {}
    grams = lambda s: {s.strip()[i : i + 3] for i in range(max(1, len(s.strip()) - 2))}
    for a, b in itertools.combinations(words, 2):
        jw = similarity.jaro_winkler_of(a, b)
        if abs(len(a) - len(b)) <= 3 and jw >= 0.89:
            j = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
            want[a, b] = "suggest" if jw >= 0.94 and (similarity.damerau_of(a, b) <= 1 or j >= 0.8) else "inspect"
    assert got == want and set(want.values()) == {"suggest", "inspect"}
    assert matching.alias_dry_run(spark.createDataFrame([(w,) for w in words], "shelf_canon string"), sample=20).count() >= 0


def test_tiered_sample(spark, sf_dir):
    rows = catalogue.works_for_sampling(lambda name: table(spark, sf_dir, name)).cache()
    total, each = 60, 20
    got = sampling.tiered_sample(rows, total)
    ids = [r.work_id for r in got.collect()]
    all_rows = [r.asDict() for r in rows.collect()]
    low = lambda v: (v is None, -(v or 0))
    order = lambda r: (*(low(r[c]) for c in sampling.ENGAGEMENT), r["work_id"])
    chosen = []
    for tier in ("thrash", "mid", "top"):
        own = sorted((r for r in all_rows if r["pop_tier"] == tier), key=order)
        cells = {}
        for r in own:
            cells.setdefault((r["publication_year"], r["genre_group"]), []).append(r)
        n = sum(map(len, cells.values()))
        quota = {c: max(1, math.floor(len(m) / n * each)) for c, m in cells.items()}
        diff = each - sum(quota.values())
        if diff > 0:
            for c in sorted(cells, key=lambda c: (-len(cells[c]), c))[:diff]:
                quota[c] += 1
        elif diff < 0:
            for c in sorted((c for c in cells if quota[c] > 1), key=lambda c: (len(cells[c]), c))[:-diff]:
                quota[c] -= 1
        taken = []
        for c, members in cells.items():
            inner = {}
            for r in members:
                if r["series_flag"] is not None and r["pages_bin"] is not None:
                    inner.setdefault((r["series_flag"], r["pages_bin"]), []).append(r)
            m = sum(map(len, inner.values()))
            q = {k: math.floor(len(v) / m * quota[c]) for k, v in inner.items()}
            for k in sorted(inner, key=lambda k: (-len(inner[k]), k))[: quota[c] - sum(q.values())]:
                q[k] += 1
            picked = [r for k, v in inner.items() for r in v[: q[k]]]
            have = {r["work_id"] for r in picked}
            picked += [r for r in members if r["work_id"] not in have][: quota[c] - len(picked)]
            taken += picked
        have = {r["work_id"] for r in taken}
        taken += [r for r in own if r["work_id"] not in have][: max(0, each - len(taken))]
        chosen += taken
    want = [r["work_id"] for r in sorted(chosen, key=order)[:total]]
    assert ids == want
    rows.unpersist()


def test_sentences(spark):
    reviews = [("r1", 1, "First one here. Second! ok. A third sentence?"), ("r1", 1, "First one here. Second! ok. A third sentence?"), ("r2", 2, None), ("r3", 2, " \n "), ("r4", 3, "Only\none   line without an end")]
    df = spark.createDataFrame(reviews, "review_id string, work_id int, review_text string")
    got = sentences.sentence_dataset(df).orderBy("sentence_id").collect()
    assert [r.sentence_id for r in got] == [0, 1, 2]
    by = {r.review_id: [] for r in got}
    for r in got:
        by[r.review_id].append((r.sentence_index, r.n_sentences_in_review, r.sentence_text))
    assert sorted(by["r1"]) == [(0, 2, "first one here."), (1, 2, "a third sentence?")] and by["r4"] == [(0, 1, "only one line without an end")]
    assert sentences.sentence_dataset(df.limit(0)).count() == 0
    assert sentences.capped(sentences.sentence_dataset(df), 2).count() == 2
    assert sentences.tokens(sentences.sentence_dataset(df)).selectExpr("sum(size(tokens))").first()[0] == 12


def test_markup_and_marks(spark):
    rows = [("Tom &amp; Jerry <b>and</b>&nbsp;co &lt;x&gt; &bogus; end", 1), (None, 2), ("", 3), ("Ünïcode  ﬁne", 4)]
    got = spark.createDataFrame(rows, "s string, i int").select("i", clean.full_clean(F.col("s")).alias("f"), clean.light_clean(F.col("s")).alias("l"), clean.canonical_tag(F.col("s")).alias("c")).orderBy("i").collect()
    assert got[0].f == "Tom & Jerry and co end" and got[0].l == "Tom & Jerry and co &bogus; end"
    assert got[1].f is None and got[1].c == "" and got[2].f == "" and got[3].c == "unicode fine"
    langs = spark.createDataFrame([("the cat is in the house",), ("le chat est dans la maison",), ("12345 67890 !!",), (None,), ("the",)], "t string").select(clean.is_english_review(F.col("t")).alias("e")).collect()
    assert [r.e for r in langs] == [True, False, False, False, False]


def test_main_text(spark):
    df = spark.createDataFrame([(" ", "short", "the longest of them"), (None, None, ""), ("abc", "x" * 50, None), ("", "ab", "cd")], "body string, note string, zzz string")
    got = [r[0] for r in df.select(headers.main_text(df.columns)).collect()]
    assert got == ["the longest of them", None, "abc", "ab"]


def test_readers(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text('{"work_id": "1", "v": "first and longer than the other file by far"}\n{"work_id": "2", "v": "x"}\n{"work_id": "2", "v": "y"}\n')
    b.write_text('{"work_id": "1", "v": "last"}\n{"book_id": "9", "v": "z"}\nbroken\n')
    got = readers.json_lookup(spark, str(tmp_path / "*.json"), "work_id string, book_id string, v string", ["work_id", "book_id"]).collect()
    assert sorted((r.work_id or r.book_id, r.v) for r in got) == [("1", "last"), ("2", "y"), ("9", "z")]
    errors = readers.read_errors(readers.json_lines_with_errors(spark, str(b), "work_id string, v string").cache()).first()
    assert (errors.n_lines, errors.n_errors) == (3, 1)
    numbers = readers.json_lines(spark, str(a), "work_id string, v string", numbers=["work_id", "v"]).collect()
    assert sorted(r.work_id for r in numbers) == [1, 2, 2] and all(r.v is None for r in numbers)
    assert readers.newest(spark, str(tmp_path / "*.json")).endswith(".json") and readers.first_existing(spark, str(tmp_path / "none"), str(a)) == str(a)
    assert readers.csv_or_none(spark, str(tmp_path / "none.csv")) is None
    with pytest.raises(ValueError):
        readers.by_extension(spark, "x.pkl")
    with pytest.raises(FileNotFoundError):
        readers.newest(spark, str(tmp_path / "*.nothing"))
    assert readers.by_extension(spark, str(a), first=2).count() == 2
    profile = {r.key: (r.n, r.share) for r in readers.key_profile(spark.createDataFrame([('{"a": 1}',), ('{"a": 2, "b": "x"}',)], "t string"), "t").collect()}
    assert profile == {"a": (2, 100.0), "b": (1, 50.0)}
    assert {r.item: r.n for r in readers.item_counts(spark.createDataFrame([(["x", "y"],), (["x"],), (None,)], "s array<string>"), "s").collect()} == {"x": 2, "y": 1}
    log = tmp_path / "run.log"
    log.write_text("2024 - Progress: 1,000 processed | Rate: 9.5 reviews/sec\n2025 - Progress: 2,305,000 processed | Rate: 144.8 reviews/sec | Matched: 1,322,565 (57.38%) | English: 1,232,141 (93.16% of matched) | Written: 1,232,141 (100.00% of English) | Elapsed: 265.3 min\n")
    last = readers.last_progress(spark, str(log))
    assert (last["processed"], last["rate"], last["matched_pct"], last["written"], last["elapsed_min"], last["timestamp"]) == (2305000, 144.8, 57.38, 1232141, 265.3, "2025")
    (tmp_path / "p.json").write_text('{"a": {"b": 1}}')
    assert readers.parameters(str(tmp_path / "p.json")) == {"a": {"b": 1}}
    np.save(tmp_path / "m.npy", np.arange(6).reshape(2, 3))
    assert readers.array_file_to_json(str(tmp_path / "m.npy"), str(tmp_path / "m.json")) == 2 and json.loads((tmp_path / "m.json").read_text()) == [[0, 1, 2], [3, 4, 5]]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", ["x"]), (2, None, [])], "i int, s string, l array<string>")
    with pytest.raises(ValueError):
        sinks.save(df, str(tmp_path / "no"), "xlsx")
    for kind in sinks.FORMATS:
        sinks.save(df, str(tmp_path / kind), kind)
    assert readers.csv_texts(spark, str(tmp_path / "csv")).count() == 2 and spark.read.parquet(str(tmp_path / "parquet")).schema == df.schema
    path = str(tmp_path / "grown")
    assert sinks.append_new(spark, df.select("i", "s"), path, "i") == 2 and sinks.append_new(spark, df.select("i", "s"), path, "i") == 0
    assert sinks.append_new(spark, spark.createDataFrame([(2, "z"), (3, "q"), (3, "q")], "i int, s string"), path, "i") == 1
    assert sorted(r.i for r in readers.csv_texts(spark, path).collect()) == ["1", "2", "3"]
    sinks.tsv(df, str(tmp_path / "t"), "s", "i")
    assert [p.read_text() for p in sorted((tmp_path / "t").glob("part-*")) if "a|b" in p.read_text()][0].startswith("a|b\ttrain\t1")
    sinks.reports({"rows": df.select("i", "s")}, "Title", str(tmp_path / "r"))
    assert "| 1 | a\\|b |" in (tmp_path / "r/report.md").read_text() and "<td>a|b</td>" in (tmp_path / "r/report.html").read_text()
    sinks.json_report({"n": np.int64(3), "rows": df, "x": float("nan")}, str(tmp_path / "j.json"))
    assert json.loads((tmp_path / "j.json").read_text())["rows"][0] == {"i": 1, "s": "a|b", "l": ["x"]}
    for _ in range(2):
        sinks.provenance(spark, str(tmp_path), step="test")
    assert spark.read.text(str(tmp_path / "provenance")).count() == 2
    calls = []

    def make(keys):
        calls.append(keys.count())
        return keys.withColumn("v", F.col("i") * 2)

    at = str(tmp_path / "once")
    assert sinks.computed_once(spark, df.select("i"), "i", make, at, "m1").count() == 2
    assert sinks.computed_once(spark, spark.createDataFrame([(2,), (5,)], "i int"), "i", make, at, "m1").count() == 2 and calls == [2, 1]
    assert sinks.stamped("/x/", "n", ".csv").startswith("/x/n_2")


def test_resumed_extraction(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write = lambda name, rows: (tmp_path / "in" / name).write_text("".join(json.dumps({"review_id": i, "t": x}) + "\n" for i, x in rows))
    write("1.json", [("a", "the one is here"), ("b", "x"), ("a", "the one is here"), (None, "the two is here")])

    def go():
        source = spark.readStream.schema("review_id string, t string").json(str(tmp_path / "in"))
        rows, counts = resume.extract(source, {"long": F.length("t") >= 10, "english": clean.is_english_review(F.col("t"))}, "review_id")
        q = resume.append_once(rows, str(tmp_path / "out"), str(tmp_path / "ck"), "review_id")
        seen = []
        resume.monitor(q, seen.append, 1.0, 10)
        return seen, counts

    seen, counts = go()
    assert set(counts) == {"processed", "long", "english"} and seen[-1]["rows"] >= 1
    write("2.json", [("a", "the one is here again"), ("c", "it is the third of them")])
    go()
    assert sorted(r.review_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]
    tries = []

    def fail(n):
        tries.append(n)
        if n < 3:
            raise OSError
        return "done"

    assert resume.restarted(fail, 3, 0, (OSError,)) == "done" and tries == [1, 2, 3]
    assert resume.estimate(600, 10) == {"minutes": 1.0, "minutes_low": 0.9, "minutes_high": 1.1} and resume.estimate(1, 0)["minutes"] is None
    rows = spark.range(20)
    place = str(tmp_path / "chunks")
    assert resume.in_chunks(spark, rows, "id", place, 3, lambda x: x) == 3 and resume.in_chunks(spark, rows, "id", place, 3, lambda x: x) == 0
    assert spark.read.parquet(place).count() == 20


def test_topics(spark):
    draw = np.random.default_rng(6)
    kinds = [["dragon", "castle", "sword", "magic"], ["doctor", "hospital", "nurse", "patient"], ["horse", "ranch", "cowboy", "saddle"]]
    texts = [(i, " ".join(draw.choice(kinds[i % 3], 8))) for i in range(180)]
    df = spark.createDataFrame(texts, "id int, t string")
    got = runners.run_topics(df, "id", "t", cluster__n_topics=3, reduce__n_components=3, cluster__outlier_share=0.0, cluster__min_cluster_size=5)
    where = {}
    for r in got["assigned"].collect():
        where.setdefault(r.topic, []).append(r.id % 3)
    assert len(where) == 3 and all(Counter(v).most_common(1)[0][1] / len(v) > 0.9 for v in where.values())
    words = {}
    for r in got["words"].collect():
        words.setdefault(r.topic, []).append(r.word)
    assert sorted(tuple(sorted(w[:4])) for w in words.values()) == sorted(tuple(sorted(k)) for k in kinds)
    assert topics.diversity(got["words"], 4).first()[0] == 1.0
    tokens = df.withColumn("tokens", clean.counted_words(F.col("t")))
    good = {r.topic: (r.npmi, r.c_v) for r in topics.coherence(got["words"], tokens, top=4).collect()}
    mixed = spark.createDataFrame([(0, k + 1, kinds[k % 3][k // 3]) for k in range(4)], "topic int, rank int, word string")
    bad = topics.coherence(mixed, tokens, top=4).first()
    assert len(good) == 3 and all(n > bad.npmi and c > bad.c_v for n, c in good.values())
    assert sum(r.n for r in got["sizes"].collect()) == 180
    with pytest.raises(ValueError):
        topics.TopicModel().set(words__nothing=1)
    with pytest.raises(ValueError):
        topics.TopicModel().set(cluster__n_topics=1).check()


def test_search(tmp_path):
    space = {"x": search.Dimension("real", -2, 2), "k": search.Dimension("categorical", values=("a", "b"))}
    score = lambda p: -((p["x"] - 1) ** 2) - (p["k"] == "a")
    path = str(tmp_path / "trials.json")
    first = search.Search(space, path=path).run(score, 8)
    again = search.Search(space, path=path)
    assert len(again.trials) == 8 and again.best() == first
    best = again.run(score, 30)
    assert len(again.trials) == 30 and best["score"] >= first["score"] and best["score"] > -0.1
    whole = search.Search(space)
    assert whole.run(score, 30)["parameters"] == best["parameters"]  # replayed trials lead to the same ones
    assert search.number_of_runs(space) == 30
    assert set(search.space_of({"top": {"type": "integer", "min": 1, "max": 3}, "grams": {"type": "categorical", "values": [[1, 1], [1, 2]]}})) == {"words__min_df", "top", "grams"}
    for bad in (dict(space={}), dict(space=space, acquisition="X"), dict(space=space, initial=0)):
        with pytest.raises(ValueError):
            search.Search(**bad)
    early = search.Search(space, initial=50)
    early.run(lambda p: 0.0, 50, patience=4)
    assert len(early.trials) == 5
    assert search.Search(space, maximize=False).tell({"x": 0.0, "k": "a"}, [1.0, 5.0, 2.0]) == 2.0


def test_hybrid_classifier(spark):
    draw = np.random.default_rng(8)
    names = [f"{w} {i}" for w in ("romance", "kindle", "series") for i in range(40)]
    at = {"romance": [1, 0, 0], "kindle": [0, 1, 0], "series": [0, 0, 1]}
    tags = spark.createDataFrame([(n, [float(v) for v in np.array(at[n.split()[0]]) + draw.normal(0, 0.2, 3)], 3) for n in names], "shelf_canon string, embedding array<float>, count int")
    labels = spark.createDataFrame([(n, {"romance": "GENRE", "kindle": "FORMAT_MEDIUM", "series": "SERIES_STRUCTURE"}[n.split()[0]]) for n in names if int(n.split()[1]) < 25], "shelf_canon string, human_category string")
    got = hybrid.run(tags, labels, least=0.7)
    assert got["predicted"].count() == 120
    assert got["predicted"].filter("pred_category = rule_category").count() == 120
    report = {r["class"]: (r.precision, r.recall) for r in got["evaluation"]["report"].collect()}
    assert set(report.values()) == {(1.0, 1.0)} and len(report) == 3
    unsure = hybrid.predict(got["model"], hybrid.with_rule(tags), least=1.1)
    assert {r.final_category for r in unsure.collect()} == {"UNKNOWN_OTHER"}
    assert tagging.focus_export(got["predicted"], ["GENRE"]).count() == 40
    with pytest.raises(ValueError):
        hybrid.labelled(tags, labels.drop("human_category"))


def test_runs(spark, sf_dir, tmp_path):
    t = lambda name: table(spark, sf_dir, name)
    work = runners.build(catalogue.editions(t), *catalogue.sources(t)).cache()
    assert work.columns[: len(runners.COLUMNS)] == runners.COLUMNS and quality.column_check(work, runners.COLUMNS) == {"missing": [], "extra": ["title_source"]}
    with pytest.raises(ValueError):
        quality.require(work, ["nothing"])
    with pytest.raises(ValueError):
        quality.check_build(work.withColumn("publication_year", F.lit(1900)))
    own = work.withColumn("book_id_list_en", F.array_join("book_id_list_en", ","))
    out = runners.run_quality(own, str(tmp_path / "q"))
    assert out["steps"] == list(runners.quality_steps()) and out["rows"].count() > 0
    assert out["certificate"].first().gates_total == 5
    again = runners.chain(own, runners.quality_steps(), str(tmp_path / "q"))[0]
    assert again.count() == out["rows"].count()
    audit = runners.run_audit(own, str(tmp_path / "a"))
    assert audit["missing"].count() == len(own.columns) and (tmp_path / "a/report.md").exists()
    assert runners.run_analysis(work)["numbers"].count() == 6
    texts = runners.run_texts(work)
    assert {r["check"] for r in texts["gate"].collect() if r.n_failed} == set() and "text_preprocessing_applied" in texts["rows"].columns
    tags = runners.run_tags(work, "popular_shelves", "validate")
    assert {"canonical", "books", "segments_long", "coverage", "flags"} <= set(tags) and all(df.count() >= 0 for df in tags.values())
    reviews = spark.createDataFrame([("r1", r, "the book is one of the best") for r in [work.first().book_id_list_en[0]]] + [("r2", "no such", "the book is it")], "review_id string, book_id string, review_text string")
    extracted = runners.run_reviews(reviews, work, "works")
    assert extracted["reviews"].count() == 1 and {r.metric: r.value for r in extracted["funnel"].collect()} == {"processed": 2, "matched": 1, "english": 1}
    full = works.analysis_columns(work).withColumn("series_flag", works.series_flag(F.col("series_id")))
    validation = runners.run_corpus_report(full, full.filter("work_id % 3 = 0"))["validation"].collect()
    assert len(validation) >= 9 and all(0 <= r.p_value <= 1 for r in validation if r.p_value is not None)
    assert runners.sampled_subset(works.analysis_columns(work), 30).count() <= 30
    assert runners.coverage_table(work.select("work_id"), work.select("work_id").limit(5)).filter("has_reviews").count() == 5
    work.unpersist()
