"""Digests, split overlaps, packing, leakage, personal information: against brute force, with dirt."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import digests, leakage, overlap, packing, pii, queries

NAN, INF = float("nan"), float("inf")


# --- digests
def test_percentiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaab"), d, rng.paretovariate(0.7)) for d in range(4) for _ in range(3000)] + [("a", 0, NAN), ("a", 0, None), ("b", 0, -INF), ("c", 1, None), (None, 1, 2.0), ("one", 1, 7.0)] + [("tie", 1, 3.0)] * 50
    d = spark.createDataFrame(rows, "k string, day int, v double").repartition(7)
    qs = [0.01, 0.5, 0.9, 0.999]
    fine, got = digests.certified_percentiles(d.withColumn("n", F.lit("clash")), ["k"], "v", qs, ["day"], size=300)
    got = got.collect()
    for k in ("a", "b"):
        v = np.sort([x for g, _, x in rows if g == k and x is not None and np.isfinite(x)])
        for q in qs:
            r = next(r for r in got if r.k == k and r.q == q)
            assert r.n == len(v) and r.within_bound and r.below == (v < r.estimate).sum() and r.upto == (v <= r.estimate).sum()
    assert {r.estimate for r in got if r.k == "tie"} == {3.0} and {r.estimate for r in got if r.k == "one"} == {7.0} and not [r for r in got if r.k == "c"]
    first, rest = fine.where("day < 2"), fine.where("day >= 2")
    halves = digests.merge_digests(digests.merge_digests(first, ["k"], 300).unionByName(digests.merge_digests(rest, ["k"], 300)), ["k"], 300)
    both = digests.certified(d, ["k"], "v", digests.estimates(halves.where("k = 'a'"), ["k"], qs), 0.01).collect()
    assert len(both) == 4 and all(r.within_bound for r in both)
    assert digests.certified_percentiles(d.limit(0), ["k"], "v", qs, ["day"])[1].count() == 0


def test_bound_is_kept(spark):
    """Groups that miss the bound are built again, larger, until none does; many groups pass through a small buffer."""
    rng = random.Random(5)
    d = spark.createDataFrame([(i % 40, 0, rng.gauss(0, 1)) for i in range(8000)], "k int, day int, v double").repartition(4)
    got = digests.certified_percentiles(d, ["k"], "v", [0.05, 0.5, 0.77], ["day"], size=4, bound=0.004)[1].collect()
    assert len(got) == 120 and all(r.within_bound and r.rank_error <= 0.004 for r in got)
    small = digests.merge_digests(digests.build_digests(d, ["k", "day"], "v", 50), ["k"], 50, buffer=60)
    assert sorted((r.k, r.n) for r in small.collect()) == [(k, 200) for k in range(40)]


def test_large_values(spark):
    d = spark.createDataFrame([("a", 1, x) for x in (1e308, 1.5e308, 1.7e308, -1.7e308) * 200], "k string, day int, v double")
    assert all(np.isfinite(r.estimate) for r in digests.certified_percentiles(d, ["k"], "v", [0.1, 0.5, 0.9], ["day"])[1].collect())


# --- full-text index
def test_index():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abc\n") for _ in range(700))
    index = overlap.FullTextIndex(text)
    patterns = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    ends = np.array([len(p) for p in patterns])
    length, low, high = index.match_ends(patterns, ends, np.arange(60))
    for p, n, a, b in zip(patterns, length, low, high):
        best = max(k for k in range(len(p) + 1) if p[len(p) - k :] in text)
        assert n == best
        if n:
            want = [i for i in range(len(text)) if text.startswith(p[len(p) - n :], i)]
            assert sorted(index.locate(np.arange(a, b))) == want
    found = set(zip(*(x.tolist() for x in overlap.maximal_matches(index, patterns, 2)[:3])))
    want = set()
    for i, p in enumerate(patterns):
        spans = [(a, b) for a in range(len(p)) for b in range(a + 2, len(p) + 1) if p[a:b] in text]
        want |= {(i, a, b - a) for a, b in spans if not any((c, e) != (a, b) and c <= a and b <= e for c, e in spans)}
    assert found == want


NAMES = ["trn_c06_20140116_001546.jpg", "trn%20c06%2020140116%20001546.png", "Copy of TRN_C06_20140116_001546 (1).JPG", "trn_c6_2014-01-16_1546.jpg", "640_trn.c06.20140116.001546_aug_3_jpg.rf.0a1b.jpg", "dup-trn-c06-20140116-001546~2.jpeg"]


def test_pictures(spark, monkeypatch):
    rows = [(i, f"/mnt/aug/x/run_1/{'train' if i % 2 else 'VAL'}/images/{n}") for i, n in enumerate(NAMES)]
    rows += [(20, None), (21, "/mnt/aug/x/run_1/train/images/IMG_0042.jpg"), (22, "\\mnt\\aug\\y\\run_2\\Test\\.\\images\\trn_c06_20140116_001546.jpg"), (23, "/mnt/aug//x/run_1/train/images/trn_c06_20140116_001547.jpg"), (24, "/mnt/aug/x/run_1/other/trn_c06_20140116_001546.jpg"), (None, "/mnt/aug/x/run_1/train/images/" + NAMES[0])]
    rows += [(25, "/mnt/aug/x/run_1/test/images/trn_c06_20140116_00154.jpg"), (26, "/mnt/aug/x/run_1/test/images/xtrn_c06_20140116_15460.jpg"), (27, "/mnt/aug/x/run_1/test/images/|trn|6|20140116|1546|.jpg")]
    d = spark.createDataFrame(rows, "error_id bigint, path string").withColumn("key", F.lit("clash"))
    p = overlap.scored_pictures(d)
    assert {r.key for r in p.where("error_id < 20 or error_id = 22").select(overlap.shown(F.col("name")).alias("key")).collect()} == {"|trn|6|20140116|1546|"}
    train, held = [1, 3, 5], [0, 2, 4, 22]
    assert {tuple(r) for r in overlap.overlapping_pairs(p, shard_names=2).collect()} == {(min(a, b), max(a, b)) for a in train for b in held}
    counts = overlap.overlap_counts(p).collect()
    assert sum(r.pairs for r in counts) == 12 and {(r.split, r.source) for r in counts} == {("valid", "x"), ("test", "y")}
    assert overlap.overlapping_pairs(p.limit(0)).count() == 0
    monkeypatch.setattr(overlap, "search", lambda shown, shards: spark.createDataFrame([], "shown string, name_id bigint"))
    assert overlap.overlapping_pairs(p).count() == 0  # the pairs are what the index finds


def test_search(spark):
    """Several shards in several passes find every name that holds a text, wherever in it."""
    names = [(i, f"{'x' * (i % 5)}|k{i % 60}|{i}") for i in range(300)] + [(900, None), (901, ""), (902, "é|k7|")]
    n = spark.createDataFrame(names, "name_id bigint, name string").repartition(3)
    texts = [f"|k{i}|" for i in range(40, 80)] + ["|k7|"]
    t = spark.createDataFrame([(x,) for x in texts] + [(None,)], "shown string").repartition(2)
    got = {tuple(r) for r in overlap.search(t, overlap.cut(overlap.index_shards(n, 50)), 40_000).collect()}
    assert got == {(x, i) for x in texts for i, m in names if m and x in m}


# --- packing
@pytest.mark.parametrize("capacity", [10, 97])
def test_pack(spark, capacity):
    rng = random.Random(capacity)
    docs = [(i, rng.choice([0, 1, 3, capacity, capacity + 1, 5 * capacity, rng.randint(1, 3 * capacity)])) for i in range(400)] + [(None, 5), (7000, None), (3, 2)]
    specs = spark.createDataFrame([(1, capacity), (2, None), (3, 0)], "spec_id int, capacity int")
    d = spark.createDataFrame(docs, "doc_id bigint, size bigint").withColumn("slot", F.lit("clash")).repartition(3)
    c = packing.pack(d, specs, block=150)
    rows = c.collect()
    per, bins, pieces = {}, {}, {}
    for r in rows:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.token_end - r.token_start
        bins.setdefault(r.container, []).append(r)
        pieces.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
    want = {}
    for i, s in docs:
        if i is not None and s:
            want[i] = want.get(i, 0) + s
    assert per == want
    assert all(sum(r.token_end - r.token_start for r in b) <= capacity and sorted(r.slot for r in b) == list(range(len(b))) for b in bins.values())
    for i, s in docs[:400]:
        if i != 3 and s:
            spans = sorted(pieces[i])
            assert len(spans) == max(1, -(-s // capacity)) and spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == s
    assert {r.doc_id for r in packing.divided(c).collect()} == {i for i, s in docs if i is not None and s and s > capacity}
    assert packing.fill(c).first().filled > 0.9 and packing.pack(d.limit(0), specs).count() == 0
    assert tuple(packing.checks(c).first())[3:] == (0, 0)


@pytest.mark.parametrize(("capacity", "n", "least"), [(10, 7, 0), (97, 500, 0.9), (2048, 20_000, 0.98), (8192, 20_000, 0.98), (3, 50, 0)])
def test_bins(capacity, n, least):
    """Each class's containers hold exactly as many of its documents as the class says, all but one."""
    rng = np.random.default_rng(capacity)
    for sizes in (rng.integers(1, capacity + 1, n), np.minimum(capacity, 1 + rng.exponential(capacity / 9, n).astype(np.int64)), np.full(n, capacity // 2), np.full(n, capacity), np.ones(n, np.int64)):
        where, kinds = packing.harmonic_bins(sizes, capacity)
        assert (np.bincount(where, weights=sizes) <= capacity).all() and (np.bincount(where) > 0).all() and len(kinds) == where.max() + 1
        own = capacity // sizes
        for i in range(1, packing.CLASSES):
            held = [int((own[where == c] == i).sum()) for c in np.flatnonzero(kinds == i)[:200]]
            assert all(h == i for h in held[:-1]) and all(0 < h <= i for h in held)
        if len(set(sizes.tolist())) > 5:
            assert sizes.sum() / capacity / len(kinds) > least


def test_no_bins():
    assert all(len(x) == 0 for x in packing.harmonic_bins(np.array([], np.int64), 10))


# --- leakage
def test_leaks(spark):
    rng = random.Random(4)
    vocab = ["la", "Été", "tide", "x1", "bread", "ok", "noon", "río", "gas"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40)))) for i in range(30)] + [(90, None), (None, "a"), (91, "")]
    docs = []
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        k = rng.randint(8, 20)
        src = items[rng.randrange(30)][1].split()
        a = rng.randrange(max(1, len(src) - k + 1))
        w[len(w) // 2 : len(w) // 2] = src[a : a + k]
        docs.append((i, "".join(rng.choice([x, x.upper()]) + rng.choice([" ", ", ", " (Hear [hear] la!) ", "\n", " ["]) for x in w)))
    docs += [(500, None), (501, ""), (None, "x"), (502, items[0][1] + " \x00 " + "w " * 20_000)]

    def plain(t):
        return re.findall(r"[^\W_]+", leakage.without_brackets(t).lower())

    def held(n):
        out = set()
        for d, t in docs:
            for i, s in items:
                if d is not None and t and i is not None and s:
                    w, v = plain(t), re.findall(r"[^\W_]+", s.lower())
                    grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
                    if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                        out.add((d, i))
        return out

    dd = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("shingle", F.lit("clash")).repartition(3)
    ii = spark.createDataFrame(items, "item_id bigint, text string").withColumn("position", F.lit(1))
    for n in (15, 9):
        want = held(n)
        assert {tuple(r) for r in leakage.leaks(leakage.leaked_spans(dd, ii, n)).collect()} == want and len(want) > 3
    spans = leakage.leaked_spans(dd, ii, 9).collect()
    texts, item = {d: plain(t) for d, t in docs if t}, {i: re.findall(r"[^\W_]+", t.lower()) for i, t in items if t}
    for r in spans:  # each span is a run of the item's words that neither side carries on
        w, v = texts[r.doc_id][r.word_start : r.word_start + r.n_words], item[r.item_id]
        at = [k for k in range(len(v) - r.n_words + 1) if v[k : k + r.n_words] == w]
        before, after = texts[r.doc_id][:r.word_start][-1:], texts[r.doc_id][r.word_start + r.n_words :][:1]
        assert r.n_words >= 9 and any(v[max(0, k - 1) : k] != before or not before for k in at) and any(v[k + r.n_words :][:1] != after or not after for k in at)
    assert leakage.leaked_spans(dd, ii.limit(0)).count() == 0 and leakage.leaked_spans(dd.limit(0), ii).count() == 0


# --- personal information
LIST = [("Olma", "given"), ("Rosek", "given"), ("Issuna", "given"), ("Kelbwood", "surname"), ("Pelldard", "surname"), ("Norstaud", "surname"), ("Brannich", "surname"), (None, "given")]
MEMBERS = ["The Speaker", "Evvek Brannich", None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []), ("No person here, at no cost. See paper 282/983/514, page 3; docket C-2020-002703; from 151,364,622 crowns.", []),
        ("Write to <olma.k+x@inbox.tide.test> now", [("email", "olma.k+x@inbox.tide.test")]), ("mailto:A_B@X-Y.EXAMPLE.", [("email", "A_B@X-Y.EXAMPLE")]),
        ("at kada90 at postbox dot example, or k [at] a [dot] test", [("email", "kada90 at postbox dot example"), ("email", "k [at] a [dot] test")]), ("k(at)inbox.tide.test", [("email", "k(at)inbox.tide.test")]), ("account @harbourtalk", []),
        ("call +999 (0)20 908 92 40.", [("phone", "+999 (0)20 908 92 40")]), ("(020) 230-2716, 0613-9639285 ext. 63", [("phone", "(020) 230-2716"), ("phone", "0613-9639285 ext. 63")]), ("00999 31 3070168; 05556636835; 0142.725.1756; 031/4944524", [("phone", "00999 31 3070168"), ("phone", "05556636835"), ("phone", "0142.725.1756"), ("phone", "031/4944524")]),
        ("ID 76-7982-812-V, 417.376.055/E, 166 410 896 D, 986-950-163T, 465890321d", [("id_number", x) for x in ("76-7982-812-V", "417.376.055/E", "166 410 896 D", "986-950-163T", "465890321d")]),
        ("of Apt 2A, 125 Tanbergate Street, Oaklowby KT 9675, and", [("address", "Apt 2A, 125 Tanbergate Street, Oaklowby KT 9675")]), ("No. 113/2 Larkwick Ave has", [("address", "No. 113/2 Larkwick Ave")]), ("at 2 Tanber St., Oaklowby KM 7051", [("address", "2 Tanber St., Oaklowby KM 7051")]),
        ("demeurant 187, avenue de Gantberford, KM 8569 Northlowport.", [("address", "187, avenue de Gantberford, KM 8569 Northlowport")]), ("Section 18 Street Works Act; The Moornick Road scheme", []),
        ("Last week Olma Kelbwood lost", [("name", "Olma Kelbwood")]), ("ROSEK P. VAN NORSTAUD’s post; Captain de Kelbwood-Pelldard", [("name", "ROSEK P. VAN NORSTAUD"), ("name", "de Kelbwood-Pelldard")]), ("A pensioner, Norstaud, Olma, told", [("name", "Norstaud, Olma")]), ("I, J. al-Pelldard, object", [("name", "J. al-Pelldard")]),
        ("Mr Brannich and Evvek Brannich and E. Brannich; Mr Speaker; The Norstaud Commission; the Olma Kelbwood Reservoir", []),
        ("İ. wrote olma kelbwood to us, and norstaud, rosek, or Issuna j. de pelldard", [("name", "olma kelbwood"), ("name", "norstaud, rosek"), ("name", "Issuna j. de pelldard")]), ("the kelbwood olma; olma, kelbwood; evvek brannich; olma’s kelbwood; olma.kelbwood", []),
        ("saw Dr. Zhang Wei and Mrs Łucja Żółć-Ćwik in town", [("name", "Zhang Wei"), ("name", "Łucja Żółć-Ćwik")]), ("Ms Ğelbwood came", [("name", "Ğelbwood")]),
        ("La route a touché M. Norstaud, carte", [("name", "Norstaud")]), ("Ask M. Norstaud about the bus of the day", [("name", "M. Norstaud")]),
    ],
)
def test_detector(text, want):
    d = pii.Detector(LIST, MEMBERS)
    assert [(k, text[a:b]) for k, a, b, _ in d.find(text)] == want
    assert [(k, a + 3, b + 3, u) for k, a, b, u in d.find(text)] == [x for x in d.find("😀. " + text)]


def test_surrogates():
    s = pii.Surrogates("k")
    assert {s.number(f"{i:03d}", "t") for i in range(1000)} == {f"{i:03d}" for i in range(1000)} and all(s.number(f"{i:03d}", "t") != f"{i:03d}" for i in range(100))
    assert all(pii.unpermuted(pii.permuted(x, 77, b"k", "t"), 77, b"k", "t") == x for x in range(77))
    words = [a + b + "ka" for a in "bcdfg" for b in "aeiou"]
    assert len({s.word(w) for w in words}) == 25 and all(len(s.word(w)) == 4 and s.word(w)[-1] == "a" for w in words)
    full, other = s.of("name", "Olma Kelbwood"), s.of("name", "KELBWOOD, O.")
    assert other == full.split()[1].upper() + ", " + full[0] + "."
    assert s.of("phone", "+999 20 396-5114")[-8:] == s.of("phone", "(020) 396-5114")[-8:] and s.of("phone", "+999 20 396-5114").startswith("+999 20 ")
    assert s.of("id_number", "76-7982-812-V") != "76-7982-812-V" and re.fullmatch(r"\d\d-\d{4}-\d{3}-[A-Z]", s.of("id_number", "76-7982-812-V"))
    again = pii.Surrogates("k", 1)
    assert again.word("kelbwood") != s.word("kelbwood") and again.word("kelbwood")[0] == s.word("kelbwood")[0]
    assert s.of("email", "post@mail.test") != "post@mail.test"


@pytest.mark.parametrize("name", ["Żółć", "Иванов Пётр", "Çelik Ñáñó", "王伟", "محمد علي", "Ωμέγα Παπά", "כהן", "김철수", "Æ Ø", "Li", "O.", "ÿ", "ʼn", "ẞ", "İpek", "ŁUCJA", "さくら", "नेहा"])
def test_scripts(name):
    """A surrogate is never the name, in no script; it keeps script, capitals and length."""
    for attempt in range(3):
        new = pii.Surrogates("tessera", attempt).of("name", name)
        assert new != name and len(new) == len(name)
        parts = list(zip(re.findall(r"[^\W\d_]+", name), re.findall(r"[^\W\d_]+", new), strict=True))
        assert all(a != b for a, b in parts if pii.alphabet(a[0].lower()[0]))
        for a, b in zip(name, new):
            assert a.isupper() == b.isupper() and (not pii.alphabet(a.lower()[0]) or pii._script(a) == pii._script(b))


def test_personal(spark):
    docs = spark.createDataFrame([(1, "Olma Kelbwood (olma@x.test) and OLMA KELBWOOD."), (2, None), (3, ""), (4, "word " * 100_000 + "Rosek Norstaud"), (1, "Olma Kelbwood")], "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    names, members = spark.createDataFrame(LIST, "name string, kind string"), spark.createDataFrame([(m,) for m in MEMBERS], "full_name string")
    found = pii.cut(pii.find_personal(docs, names, members))
    rows = pii.with_surrogates(found, "k").collect()
    assert sorted((r.doc_id, r.kind, r.start_pos, r.end_pos) for r in rows) == [(1, "email", 15, 26), (1, "name", 0, 13), (1, "name", 0, 13), (1, "name", 32, 45), (4, "name", 500_000, 500_014)]
    assert len({r.surrogate.lower() for r in rows if r.value.lower() == "olma kelbwood"}) == 1
    out = pii.rewrite(docs, names, members, "k").collect()
    assert "[NAME] ([EMAIL]) and [NAME]." in {r.redacted for r in out} and "" in {r.redacted for r in out}
    assert {r.surrogate for r in rows if r.doc_id == 4} <= {r.surrogated[-14:] for r in out if r.doc_id == 4}
    assert pii.with_surrogates(pii.cut(pii.find_personal(docs.limit(0), names, members)), "k").count() == 0


def test_checked(spark):
    """Numbers that fill most of their format meet real ones under any key; re-keyed, none does, and all spellings follow."""
    s = pii.Surrogates("k")
    start = [f"12-{i:07d}-{c}" for i in range(40) for c in "ABCDEFG"]
    real = start + [s.of("id_number", v) for v in start[:60]]  # these are surrogates of others
    values = [(i, "id_number", 0, 1, v, pii.unit_of("id_number", v)) for i, v in enumerate(real + [v.lower() for v in real])]
    found = pii.cut(spark.createDataFrame(values, "doc_id bigint, kind string, start_pos int, end_pos int, value string, unit string"))
    plain = found.withColumn("attempt", F.lit(0))
    assert plain.count() and pii.checked_attempts(found, "k").count() >= 60
    got = pii.with_surrogates(found, "k")
    assert pii.clashes(pii.cut(got)).count() == 0
    by_value = {}
    for r in got.collect():
        by_value.setdefault(r.value.lower(), set()).add(r.surrogate.lower())
    assert all(len(x) == 1 for x in by_value.values()) and len({next(iter(x)) for x in by_value.values()}) == len(by_value)


def test_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
