"""Operators over a corpus against brute force on small tables."""

import random
import re
import string
from pathlib import Path

import numpy as np
import pytest
import xxhash

from cinderspark.llm import decontamination, exact_dedup, secret_scan, simhash, toxicity
from cinderspark.llm.vptree import Forest, distance, fit_routing, link
from cinderspark.scratch import staged_paths

WORDS = [a + b for a in ("th", "on", "er", "an", "re") for b in ("ing", "ed", "ly", "ou", "tion", "a")]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


# --- exact de-duplication ----------------------------------------------------
def groups_of(rows):
    out = {}
    for i, t in rows:
        out.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    want = []
    for members in out.values():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        want += [(i, keep, len(members), i == keep) for i, _ in members]
    return sorted(want, key=str)


def dedup_rows():
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randint(0, 6))) for k in range(120)]
    rows += [(200 + k, "hot   text" + " " * (k % 3)) for k in range(80)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, " "), (None, "lonely"), (304, "x" * 200_000), (305, "x" * 200_000 + " ")]
    return rows


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    rows = dedup_rows()
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, digest string, n_chars int").repartition(6)
    options = {"digest": lambda c: exact_dedup.F.length(c).cast("string")} if weak else {}  # every length collides
    got = exact_dedup.exact_groups(docs, **options).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got], key=str) == groups_of(rows)


def test_colliding_digests_of_a_repeated_id(spark):
    rows = [(1, "aaa"), (1, "bbb"), (2, "a aa"), (None, "ccc"), (None, "ddd")] + [(9, "eee")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_groups(docs, digest=lambda c: exact_dedup.F.length(c).cast("string")).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got], key=str) == groups_of(rows)
    kept = exact_dedup.deduplicate(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, "bbb"), (2, "a aa"), (9, "eee"), (None, "ccc"), (None, "ddd")], key=str)


def test_exact_rows_that_stay(spark):
    rows = dedup_rows() + [(0, dedup_rows()[0][1])]  # a row given twice
    docs = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, hot string")
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({k for _, k, _, _ in groups_of(rows)}, key=str)
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


# --- SimHash -----------------------------------------------------------------
def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


@pytest.mark.parametrize("text", ["", "  \n", "One", "a b c d", "A b\tC d e É", "x " * 300, "\x1ca\x1c b c d e f", "a b c d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near_points(rng, n=400, copies=3):
    base = rng.integers(0, 2**64, n, np.uint64)
    out = [base]
    for _ in range(copies):
        f = base.copy()
        for _ in range(3):
            f ^= (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.4)
        out.append(f)
    return np.unique(np.concatenate(out))


def test_routing_and_search_miss_nothing():
    points = near_points(np.random.default_rng(1))
    near = distance(points[:, None], points[None, :]) <= 4
    i, j = np.nonzero(near)
    tree = fit_routing(points[::3], 4)
    home = tree.home(points)
    visited = set(zip(*(x.tolist() for x in tree.visits(points, 4))))
    assert all((a, home[b]) in visited for a, b in zip(i.tolist(), j.tolist()))
    want = Forest(len(points))
    want.join(i, j)
    assert (link(points, points[:0], 4) == want.roots(np.arange(len(points)))).all()
    half = len(points) // 2
    got = link(points[:half], points[half:], 4)
    some = Forest(len(points))
    keep = (i < half) | (j < half)
    some.join(i[keep], j[keep])
    assert (got == some.roots(np.arange(len(points)))).all()


@pytest.mark.parametrize("piece", [None, 20])
def test_near_groups(spark, monkeypatch, piece):
    if piece:
        monkeypatch.setattr(simhash, "PIECE_POINTS", piece)  # a leaf's visitors in many pieces
    rng = random.Random(7)
    rows = [(k, prose(rng, rng.randint(0, 60))) for k in range(150)]
    rows += [(200 + k, rows[k % 5][1] + " " + rng.choice(WORDS)) for k in range(60)]
    rows += [(400 + k, "the same words again and again") for k in range(50)] + [(500, None), (501, ""), (502, "x " * 5000)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string").repartition(5)
    got = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    fps = np.array([plain_fingerprint(t or "") for _, t in rows], np.uint64)
    ids = np.array([i for i, _ in rows])
    near = distance(fps[:, None], fps[None, :]) <= 4
    label = ids.copy()
    while True:
        new = np.array([label[near[k]].min() for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    assert len(got) == len(rows)
    for i, f, c in zip(ids.tolist(), fps.tolist(), label.tolist()):
        assert (got[i].fingerprint, got[i].component_id) == (f"{f:016x}", c)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.tolist()))
    assert simhash.near_groups(docs.limit(0)).count() == 0


# --- secrets -----------------------------------------------------------------
def plain_base(text):
    spans = []
    rank = {"assign": 0, "access": 1, "hex": 2}
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), rank["assign"], "assign", m.end()))
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def plain_entropy(text):
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        c = m[0]
        if not re.search("[0-9]", c) or re.search(secret_scan.ALLOWED, c):
            continue
        limit = next(bits for p, bits in secret_scan.ENTROPY_LIMITS if re.search(p, c))
        hits = []
        for o in range(len(c) - 19):
            counts = np.array([c[o : o + 20].count(x) for x in set(c[o : o + 20])]) / 20
            if -(counts * np.log2(counts)).sum() > limit:
                hits.append(o)
        if hits:
            out.append((m.start() + hits[0], 3, "entropy", m.start() + hits[-1] + 20))
    return out


def test_secrets(spark):
    rng = random.Random(2)
    parts = ["token = ", 'Api_Key: "', "PASSWORD='", "secret=", "AKIA", "é😀", "\n", " ", "deadbeef0123", "0123456789abcdef" * 2, ".", "token=secret: ", "x"]
    texts = []
    for _ in range(150):
        made = [rng.choice(parts) if rng.random() < 0.7 else "".join(rng.choices(string.ascii_letters + string.digits + "+/=_-", k=rng.randint(5, 40))) for _ in range(rng.randint(1, 12))]
        texts.append("".join(made))
    texts += ["", "550e8400-e29b-41d4-a716-446655440000", "a" * 100_000 + "1", "Q7" * 3000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(999, None, "x")], "doc_id long, text string, assign string")
    out = {r.doc_id: r for r in secret_scan.secret_digests(docs).collect()}
    assert len(out) == len(texts) + 1
    import hashlib

    for k, t in [*enumerate(texts), (999, "")]:
        base = plain_base(t)
        show = lambda spans: ",".join(f"{n}:{s}:{e}" for s, _, n, e in spans)
        assert out[k].base_sha256 == hashlib.sha256(show(base).encode()).hexdigest(), t
        assert out[k].spans == show(sorted(base + plain_entropy(t))), t
        assert (out[k].n_assign, out[k].n_access, out[k].n_hex) == tuple(sum(b[1] == r for b in base) for r in range(3))


def test_secrets_in_great_number(spark):
    import time

    text = "deadbeefdeadbeef 0a1b2c3d4e5f6071 " * 10_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secret_scan.secret_digests(docs.limit(0)).collect()
    start = time.perf_counter()
    out = secret_scan.secret_digests(docs).first()
    assert out.n_hex == 20_000 and out.spans.startswith("hex:0:16,") and out.spans.endswith(f"hex:{len(text) - 17}:{len(text) - 1}")
    assert time.perf_counter() - start < 20
    assert secret_scan.secret_digests(docs.limit(0)).count() == 0
    assert [r.spans for r in secret_scan.secret_digests(docs.withColumn("text", secret_scan.F.lit("AKIA" + "Q" * 20)).union(docs).union(docs)).collect()][1] == out.spans


# --- decontamination ---------------------------------------------------------
ITEMS = [
    (1, "Anna Smith has 12 apples and gives Bob 5 apples. How many apples does Anna Smith keep after 3 days of rain?"),
    (2, "thing one and other words stand here in this order only once"),
    (3, "two words"),
    (4, ""),
    (5, None),
]


def test_decontamination(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    filler = "ting erou and the. " * 30
    rows = [
        (1, filler + ITEMS[0][1] + filler, 1),
        (2, filler + ITEMS[0][1].replace("12", "99").replace("Anna Smith", "Zoe Jones").replace("days", "weeks") + filler, 1),
        (3, filler, None),
        (4, "Two words.", 3),
        (5, "thing one and other words but then it differs wholly from what stood there", None),
        (6, None, None),
        (7, "", None),
        (8, ("pad " * 40_000) + ITEMS[1][1], 2),
        (8, ("pad " * 40_000) + ITEMS[1][1], 2),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, item_id string")
    got = sorted((r.doc_id, r.item_id) for r in decontamination.contamination(docs, bench).collect() if r.contaminated)
    assert got == sorted((i, n) for i, _, n in rows if n)
    reworded = {r.doc_id: r.reworded for r in decontamination.contamination(docs, bench).collect()}
    assert reworded[2] and not reworded[1]
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7]
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def plain_hits(item, text, window=5):
    """The windows that an item and a text share, by comparing all with all."""
    words = text.split()
    places = [k for k in range(len(words)) if decontamination.template_at(words, k)]
    ts, own = decontamination.template(text)
    assert ts == [decontamination.template_at(words, k) for k in places]
    its, item_own = decontamination.template(item)
    size = min(window, len(its))
    return len(its), [
        {"p": p, "o": o, "first_word": places[p], "end_word": places[p + size - 1] + 1, "words": ts[p : p + size], "own": own[p : p + size], "item_own": item_own[o : o + size]}
        for p in range(len(ts) - size + 1)
        for o in range(len(its) - size + 1)
        if its and ts[p : p + size] == its[o : o + size]
    ]


def plain_matches(items, text):
    out = {}
    for i, item in items:
        n, hits = plain_hits(item or "", text or "")
        if hits:
            out[i] = decontamination.score_pair(n, hits)
    return out


def plain_coverage(item, text, window=5):
    """Written apart from ``score_pair``: the share of an item's words in windows whose slots agree along an alignment."""
    n, hits = plain_hits(item, text, window)
    covered = set()
    for shift in {h["p"] - h["o"] for h in hits}:
        pairs = []
        for h in sorted((h for h in hits if h["p"] - h["o"] == shift), key=lambda h: h["o"]):
            new = pairs + [(a, b) for t, a, b in zip(h["words"], h["item_own"], h["own"]) if t in ("<num>", "<name>", "<unit>")]
            if all((a == c) == (b == d) for a, b in new for c, d in new):
                pairs = new
                covered |= set(range(h["o"], h["o"] + len(h["words"])))
        if n < window and len(covered) == n:
            return 1.0
    return len(covered) / n


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    slots = ["Anna Bell", "3", "7", "12 km", "5 days", "7 weeks", "Bob"]
    items = [(k, " ".join(rng.choices(WORDS, k=6)) + " " + " ".join(rng.choices(slots + WORDS[:4], k=6)) + " " + prose(rng, rng.randint(0, 8))) for k in range(25)]
    items += [(40, "two words"), (41, "from 3 km"), (41, "from 3 km"), (None, items[3][1]), (42, ""), (43, None)]
    rows = []
    for k in range(120):
        words = rng.choice(items)[1] or ""
        for _ in range(rng.randint(0, 3)):
            words = words.replace(rng.choice(slots), rng.choice(slots))
        cut = words.split()[: rng.randint(1, 30)]
        rows.append((rng.choice([None, 1, 2, 3, k]), prose(rng, rng.randint(0, 30)) + " " + " ".join(cut) + " two words " * (k % 9 == 0) + prose(rng, 5)))
    rows += rows[:10] + [(None, None), (None, ""), (5, ". - !"), (6, "pad " * 30_000 + items[0][1])]
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, hits string, row long").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in rows:
        found = [(n, plain_coverage(x, t or "")) for n, x in items if x and plain_hits(x, t or "")[1]]
        want.append((i, sorted(((n, round(c, 6)) for n, c in found if c >= decontamination.COVERAGE), key=str)))
    got = [(r.doc_id, sorted(((m.item_id, round(m.coverage, 6)) for m in r.matches), key=str)) for r in decontamination.find_matches(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = sorted([t for (_, t), (_, m) in zip(rows, want) if not m], key=str)
    assert sorted([r.text for r in decontamination.decontaminate(docs, bench).collect()], key=str) == clean
    assert sum(bool(m) for _, m in want) > 30 and len(clean) > 20


def test_slots_must_agree():
    swapped = ITEMS[0][1].replace("Anna Smith has", "Zoe Jones has")  # the name changes half-way
    full = plain_matches(ITEMS[:1], ITEMS[0][1])[1][0]
    assert plain_matches(ITEMS[:1], swapped)[1][0] < full
    trip = [(1, "5 km in 20 minutes")]
    assert plain_matches(trip, "8 miles in 30 seconds")[1][:2] == (1.0, True)
    assert plain_matches(trip, "5 km in 20 km")[1][0] == 0  # one unit can't stand for two


def test_short_items_inside_documents(spark):
    items = [(1, "Two words"), (2, "plain"), (3, "from 3 to 3"), (4, ITEMS[1][1])]
    found = lambda text: plain_matches(items, text)
    filler = "ting erou and the " * 20
    assert found(filler + "nine words, two words. " + filler) == {1: (1.0, False, 82, 84)}
    assert found(filler + "it is plain") == {2: (1.0, False, 82, 83)}
    assert found("plain")[2][0] == 1 and found(filler + "nine words") == {1: (1.0, True, 80, 82)}
    assert found("go from 7 to 7 now")[3][0] == 1 and found("go from 7 to 8 now")[3][0] == 0
    assert found(ITEMS[1][1] + " and plain").keys() == {2, 4} and found(filler) == {}
    texts = [filler + "nine words, two words. " + filler, "plain", "go from 7 to 7 now", "go from 7 to 8 now", filler]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = decontamination.find_matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: [(m.item_id, m.coverage, m.reworded, m.first_word, m.end_word) for m in r.matches] for r in out} == {
        0: [(1, 1.0, False, 82, 84)], 1: [(2, 1.0, False, 0, 1)], 2: [(3, 1.0, True, 1, 5)], 3: [], 4: []
    }


@pytest.mark.parametrize("broadcast", [decontamination.MOST_BROADCAST, 0])
def test_decontamination_writes_no_documents(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", broadcast)
    rng = random.Random(31)
    junk = [" ".join(f"{rng.getrandbits(64):016x}" for _ in range(500)) for _ in range(60)]
    texts = junk + [junk[0]] * 20 + [f"{junk[1]} {ITEMS[0][1]}"] * 20 + [None, "", ITEMS[1][1]]
    docs = spark.createDataFrame([(k % 7 or None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    before = staged_paths(spark)
    kept = decontamination.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert sorted((r.text for r in kept), key=str) == sorted(junk + [junk[0]] * 20 + [None, ""], key=str)
    files = [f for p in staged_paths(spark) if p not in before for f in Path(p.removeprefix("file:")).rglob("*.parquet")]
    assert 0 < sum(f.stat().st_size for f in files) < 100_000 < sum(map(len, junk)) / 4


# --- toxicity ----------------------------------------------------------------
def labelled(n=600):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 7 == 0
        words = prose(rng, rng.randint(3, 60)).split()
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["grumbit", "sludgebag", "nastyfoo"]))
        rows.append((k, " ".join(words), "en"))
        labels.append((k, int(toxic)))
    return rows + [(9000, "", "en"), (9001, None, "fr"), (9002, "word " * 50_000, "en")], labels


def test_toxicity(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(docs, marks).collect()}
    assert len(out) == len(rows)
    held = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert len(held) > 80 and sum(p == y for p, y in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values()) and out[9000].score == out[9001].score
    kept = toxicity.reject_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in out.values())
    nothing = toxicity.score_documents(docs, marks.limit(0)).collect()
    assert len(nothing) == len(rows) and all(r.score == 0 for r in nothing)


def test_a_document_is_not_its_own_neighbour(spark):
    rows, labels = labelled()
    rows += [(0, "another text of the first id grumbit", "en"), (0, "and one more of it", "en")] + [rows[7]] * 5  # one id, several texts; one row, several times
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(set(model.ids.tolist())) == len(model.ids) <= len(labels)
    index = toxicity.BlockMax(model)
    text_of = dict((i, t) for i, t, _ in rows[:600])
    known = [i for i in model.ids.tolist() if i]
    assert known and all(i not in [e[0] for e in index.score(text_of[i])[1]] for i in known)
    assert toxicity.score_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_examples_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_EXAMPLES", 50)
    rows, labels = labelled()
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    examples = toxicity._examples(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", "toxic")
    assert 0 < examples.count() <= 50 and examples.select("doc_id").distinct().count() == examples.count()


def test_block_max_equals_full_scan(spark):
    rows, labels = labelled()
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    index = toxicity.BlockMax(model)
    dense = np.zeros((len(model.ids), len(model.idf)))
    for k in range(len(model.ids)):
        at = slice(model.rows[k], model.rows[k + 1])
        dense[k, model.columns[at]] = model.values[at]
    tried = 0
    for _, text, _ in rows:
        counts = index.counts(text or "")
        if not counts:
            continue
        at, w = model.vector(counts)
        query = np.zeros(len(model.idf))
        query[at] = w
        score = dense @ query
        full = np.lexsort((model.ids, -np.round(score, 9)))[:10]
        assert index.neighbours(at, w, 10)[0].tolist() == full[score[full] > 0].tolist()
        tried += 1
    assert tried > 50


# --- decisions go with the row ------------------------------------------------
def test_rejection_goes_by_row(spark):
    rows, labels = labelled()
    bad, leak = "a grumbit sludgebag nastyfoo", "pad " * 9 + ITEMS[1][1]
    fine = ["clean first words", "clean second words", "clean third words", "clean fourth words"]
    more = [(None, bad, "x"), (None, fine[0], "x"), (9100, bad, "x"), (9100, fine[1], "x")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
    kept = {r.text for r in toxicity.reject_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert bad not in kept and kept >= set(fine[:2])
    more = [(None, leak), (None, fine[2]), (5, leak), (5, fine[3])]
    kept = decontamination.decontaminate(spark.createDataFrame(more, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, fine[2]), (5, fine[3])]


def test_near_copies_of_a_repeated_id(spark):
    rng = random.Random(17)
    a, b, c = (prose(rng, 40) for _ in range(3))
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (5, c), (5, c), (7, c)], "doc_id long, text string")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, a), (3, b), (5, c)])


def test_near_copies_without_ids(spark):
    rng = random.Random(23)
    a, b, c = (prose(rng, 40) for _ in range(3))
    docs = spark.createDataFrame([(None, a), (4, a), (None, b), (None, b), (None, b + " "), (None, c), (None, None), (None, "")], "doc_id long, text string")
    kept = simhash.deduplicate(docs)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)[:3] == sorted([(4, a), (None, b + " "), (None, c)], key=str) or kept.count() == 4
    assert sorted(str(r.text).strip() for r in kept.collect() if r.text) == sorted([a, b, c]) and kept.count() == 4


# --- pipeline ----------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    rows, labels = labelled(300)
    texts = [(i, t, "en", "s", len(t or "")) for i, t, _ in rows if i < 9000]
    clean = [t for t in texts if t[0] % 7]
    extra = [
        (5000, clean[0][1] + " ", "en", "s", 0),  # an exact copy but for white space, and longer
        (5001, clean[1][1], "en", "s", 0),
        (5002, prose(rng, 30) + " " + ITEMS[1][1], "en", "s", 0),
        (5003, "a grumbit sludgebag nastyfoo", "en", "s", 0),
    ]
    docs = spark.createDataFrame(texts + extra, "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([i for i in ITEMS if i[0] < 3], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not out & {i for i, y in labels if y and i % 7 == 0} or len(out & {i for i, y in labels if y}) <= 2
    assert clean[0][0] not in out and 5000 in out  # the longer of the two equal texts
    assert clean[1][0] in out and 5001 not in out
    assert 5002 not in out and 5003 not in out
    assert len(out) > 0.9 * len(clean) - 5
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, step, str(tmp_path)).columns == docs.columns


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null ids, null, empty and very long texts, repeated rows, clashing columns; and an empty table."""
    import corpus_pipeline

    rng = random.Random(19)
    rows, labels = labelled(200)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([i for i in ITEMS if i[0] < 3], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = prose(rng, 60_000)
    odd = [(None, None), (None, ""), (None, "lonely clean words"), (None, "lonely clean words"), (3000, long), (3001, long), (3002, None), (3003, " "), (3003, "third clean text"), (3003, "third clean text")]
    table = [(i, t, "x", k, float(k), "d") for k, (i, t) in enumerate([(i, t) for i, t, _ in rows if i < 9000 and i % 7] + odd)]
    docs = spark.createDataFrame(table, "doc_id long, text string, digest string, row long, n double, content string").repartition(3)
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, out, str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns
        assert {"lonely clean words", "third clean text", long} <= {r.text for r in out.collect()}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert [sum(r.text == t for r in out.collect()) for t in ("lonely clean words", "third clean text", long)] == [1, 1, 1]
    assert sum(not (r.text or "").strip() for r in out.collect()) == 1  # all empty texts are one
    last = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path))
    assert last.count() == out.count()
