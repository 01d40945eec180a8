"""Operators on single texts against the libraries they equal, or brute force."""

import hashlib
import random
import string

import numpy as np
import pytest
from pyspark.sql import Row

from cinderspark.llm import bpe_codec, html_render, pii_surrogates, token_counts, token_files
from cinderspark.llm.encoder import Encoder, Generations
from cinderspark.llm.rank_bpe import RankBpe

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, n_bytes string, ids string, _text string, digest string"
ODD = ["x. ", "Y, ", "). ", "3. ", "É. ", "́. ", "_, ", "㉈. ", "a", "B", "'s", "'LL", " ", "  ", "\n", "\t", " \n", "\n ", "\r\n", "é", "é", "ß", "Σ", "ΑΣ", "İ", " ", "\xa0", "\x1c", "́",
       "1", "½", "!", "...", "<|endoftext|>", "<|startoftext|>", "<|", "日本", "😀", "‍", "ǅ", "ﬁ", "Å", "x" * 60]


def fuzz(n=1500, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(n)] + ["ab" * 3000, " " * 500 + "x", ("aé" * 100 + " ") * 5, ""]


def documents(spark, rows):
    return spark.createDataFrame([Row(doc_id=i, text=t, n_bytes="x", ids="y", _text="z", digest="d") for i, t in rows], DOCS)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    path = vocabularies.path(name)
    library, ours = tokenizers.Tokenizer.from_file(path), Encoder(path)
    ours.pieces, ours.pretokens = Generations(40), Generations(40)  # generations turn over while it runs
    texts = fuzz()
    for s in range(0, len(texts), 100):
        for text, ids in zip(texts[s : s + 100], ours.encode(texts[s : s + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_matrix_and_heap_merge_alike():
    bpe = RankBpe(vocabularies.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeinorst", k=rng.randint(1, 40))).encode() for _ in range(400)]
    for word, ids in zip(words, bpe.encode_words(words)):
        assert np.frombuffer(ids, "<u4").tolist() == bpe.merge_long(word).tolist()
        assert bpe.decode(np.frombuffer(ids, "<u4")) == word


def test_long_words_and_other_schemes(tmp_path):
    import json
    import time

    path = vocabularies.path("byte_bpe_50k.json")
    library, ours = tokenizers.Tokenizer.from_file(path), Encoder(path)
    word = "".join(random.Random(8).choices(string.ascii_letters, k=200_000))
    start = time.perf_counter()
    ids = ours.encode([word])[0]
    assert time.perf_counter() - start < 5
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    spec = json.load(open(path))
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        Encoder(str(tmp_path / "other.json"))


def test_workers_keep_one_state():
    from cinderspark.llm import worker

    first = worker.kept(("a", 1), list)
    assert worker.kept(("a", 1), list) is first
    second = worker.kept(("b", 1), list)
    assert second is not first and worker.kept(("a", 1), list) is not first and len(worker._kept) == 1


def test_codec_round_trip(spark):
    texts = fuzz(200)
    rows = list(enumerate(texts)) + [(900, None), (901, "twice"), (901, "twice"), (None, "no id")]
    docs = documents(spark, rows)
    full = bpe_codec.encode_documents(docs, vocabularies.path("byte_bpe_50k.json")).collect()
    short = bpe_codec.digest_documents(docs, vocabularies.path("byte_bpe_50k.json")).collect()
    assert len(full) == len(short) == len(rows)
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    by_id = dict(rows)
    for f, s in zip(sorted(full, key=key), sorted(short, key=key)):
        assert f.decoded == (by_id[f.doc_id] or "")
        assert s.n_tokens == len(f.ids)
        assert s.ids_sha256 == hashlib.sha256(np.array(f.ids, "<u4").tobytes()).hexdigest()
        assert s.decoded_sha256 == hashlib.sha256(f.decoded.encode()).hexdigest()
    assert bpe_codec.digest_documents(docs.limit(0), vocabularies.path("byte_bpe_50k.json")).count() == 0


def test_token_counts(spark):
    library = tokenizers.Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    rows = list(enumerate(fuzz(300))) + [(900, None), (900, None), (None, "x y"), (901, "q" * 70_000 + " " + "Zz9" * 500), (902, "w" * 65 + " " + "w" * 64)]
    out = token_counts.count_tokens(documents(spark, rows), vocabularies.path("word_bpe_49k.json"), limit=5).collect()
    assert len(out) == len(rows)
    want = {i: t or "" for i, t in rows}
    for r in out:
        t = want[r.doc_id]
        assert r.n_tokens == len(library.encode(t, add_special_tokens=False).ids)
        assert r.n_bytes == len(t.encode()) and r.over_limit == (r.n_tokens > 5)
    assert token_counts.count_tokens(documents(spark, []), vocabularies.path("word_bpe_49k.json")).count() == 0


def test_token_files(spark, tmp_path):
    library = tokenizers.Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    rows = [(k * 7 % 501, t) for k, t in enumerate(fuzz(300))] + [(900, None)]
    path = str(tmp_path / "tokens")
    token_files.write_token_files(documents(spark, rows), path, vocabularies.path("word_bpe_49k.json"))
    got = token_files.read_token_files(spark, path).orderBy("doc_id").collect()
    start = 0
    for (i, t), r in zip(sorted(rows, key=lambda x: x[0]), got):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (i, start, len(ids), ids)
        start += len(ids)
    one = token_files.read_token_files(spark, path, [900]).collect()
    assert [r.doc_id for r in one] == [900] and one[0].start == start - 1
    checks = token_files.write_and_check(documents(spark, []), vocabularies.path("word_bpe_49k.json"))
    assert checks.count() == 0


def test_token_files_ties_and_split_ranges(spark, tmp_path):
    library = tokenizers.Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    rows = [(5, f"text {k % 9}") for k in range(400)] + [(k, "other") for k in range(40)] + [(None, "none"), (None, None)] + [(7, "same words")] * 300
    read = []
    for name, most in (("whole", "0"), ("split", "37")):
        path = str(tmp_path / name)
        spark.conf.set("spark.sql.files.maxRecordsPerFile", most)
        try:
            token_files.write_token_files(documents(spark, rows).repartition(5), path, vocabularies.path("word_bpe_49k.json"))
        finally:
            spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        got = sorted((r.start, r.doc_id, r.n_tokens, tuple(r.ids)) for r in token_files.read_token_files(spark, path).collect())
        start = 0
        for s, i, n, ids in got:
            assert s == start and n == len(ids) and ids[-1] == 2
            start += n
        assert [i for _, i, _, _ in got] == [None, None] + sorted(i for i, _ in rows if i is not None)
        read.append([x[1:] for x in got])
    assert read[0] == read[1]  # rows that share an id have an order of their own
    want = sorted((i is not None, i or 0, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    assert sorted((i is not None, i or 0, ids) for i, _, ids in read[0]) == want


def test_html():
    page = """<title>no</title><p>One<p>Two &amp; three<ul><li>a<li>b<ol start=3><li>x</li><li>y</ol><li>c</ul>tail <b>bold</b>
    <pre>  keep
   this</pre><table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>z<td>10</table>
    <div style="display:none">hid</div><p hidden>hid<details><summary>sum</summary>hid</details><script>x<y</script>end <i"""
    lines = html_render.render(page).split("\n")
    assert lines[:8] == ["One", "", "Two & three", "", "- a", "- b", "  3. x", "  4. y"]
    assert "Name      | Qty" in lines and "apple pie | 3" in lines and "z         | 10" in lines
    assert "   this" in lines and "sum" in lines and "end <i" in lines
    assert not any("hid" in x or "no" == x or "x<y" in x for x in lines)


def test_html_formulas_and_drawings():
    page = """<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mspace/><mn>2</mn></mrow><annotation>tex</annotation></semantics></math> holds
    <svg><title>no</title><defs/><style>s</style><circle r="1"/><text>left</text><text>right <tspan>arm</tspan></text><desc>no</desc></svg> after
    <object data=a><b>instead</b></object><noscript>no</noscript> <filter>kept</filter>"""
    assert html_render.render(page) == "so x=2 holds left right arm after instead kept"


def plain_text(page):
    """Visible words of well-formed markup, by the standard library's parser."""
    from html.parser import HTMLParser

    words, hidden = [], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag not in ("br", "hr", "img"):
                hidden.append(tag in ("script", "style", "title") or "hidden" in dict(attrs) or bool(hidden) and hidden[-1])

        def handle_endtag(self, tag):
            hidden.pop()

        def handle_data(self, data):
            if not (hidden and hidden[-1]):
                words.extend(data.split())

    Reader().feed(page)
    return words


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["p", "div", "b", "ul", "table", "text", "text", "hidden", "script", "br", "pre", "blockquote", "dl"] if depth < 5 else ["text"])
        inner = random_page(rng, depth + 1) if kind not in ("text", "br", "script") else ""
        out.append(
            {
                "text": f" w{rng.randint(0, 999)} &amp; v{rng.randint(0, 99)} ",
                "br": "<br>",
                "script": "<script>if (a < b) hidden</script>",
                "hidden": f'<div hidden data-x="{"q" * rng.choice([1, 6000])}">{inner}</div>',
                "p": f"<p title='a>b'> one two </p>{inner}",
                "b": f"<b class=x{'y' * rng.choice([1, 5000])}> bold </b>{inner}",
                "ul": f"<ul><li>{inner}</li><li> item </li></ul>",
                "dl": f"<dl><dt> t </dt><dd>{inner}</dd></dl>",
                "table": f"<table><tr><td rowspan={rng.randint(1, 200)}>{inner}</td><td colspan={rng.randint(1, 2000)}> c1 </td></tr><tr><td> c2 </td></tr></table>",
            }.get(kind, f"<{kind}>{inner}</{kind}>")
        )
    return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_html_shows_all_visible_words(seed):
    page = random_page(random.Random(seed))
    shown = [w for w in html_render.render(page).split() if w not in ("|", "-")]
    assert sorted(shown) == sorted(plain_text(page))
    if "table" not in page:  # rows of cells side by side change the order of lines
        assert shown == plain_text(page)


def test_html_is_linear():
    import time

    start = time.perf_counter()
    for page in ("<a " * 20_000, '<a x="' * 20_001, "<a x='y' " * 20_000, "<!" * 50_000, "<div>" * 50_000 + "x", "<p><b>" * 20_000, "</x>" * 50_000,
                 "<table>" + "<tr>" + "<td rowspan=100 colspan=100>x" * 300 + "</table>", "<table>" + "<tr><td rowspan=9999>x" * 3000 + "</table>"):
        html_render.render(page)
    assert time.perf_counter() - start < 15
    assert html_render.render(f"<p title={'x' * 5000}>shown") == "shown"
    spans = html_render.render("<table><tr><td rowspan=2>A<td colspan=2>B<tr><td>c<td>dd<tr><td>e<td>f<td>g</table>")
    assert spans.split("\n") == ["A | B", "  | c | dd", "e | f | g"]


@pytest.mark.parametrize("page", ["", "<", "<a", "<!--", "<script>", "</p></td>", "<table><tr>", "<div>" * 2000 + "x", "<li>" * 500, '<a href="', "&#x0;&bogus;"])
def test_html_malformed(page):
    html_render.render(page)


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b", "x"), (2, None, "y"), (2, "", "y")], "page_id long, html string, text string")
    out = sorted((r.page_id, r.text, r.n_chars, r.n_lines) for r in html_render.render_pages(pages).collect())
    assert out == [(1, "a\n\nb", 4, 3), (2, "", 0, 0), (2, "", 0, 0)]
    assert html_render.render_pages(pages.limit(0)).count() == 0


KEY = b"test key"


def test_permutations_are_bijections():
    assert sorted(pii_surrogates.permute(i, 1000, KEY, "x") for i in range(1000)) == list(range(1000))
    cards = {pii_surrogates.surrogate("card", f"4{i:014d}0", KEY) for i in range(2000)}
    assert len(cards) == 2000
    new = pii_surrogates.surrogate("card", "4111111111111111", KEY)
    assert pii_surrogates._luhn(new[:-1]) == int(new[-1])
    iban = pii_surrogates.surrogate("iban", "GB29NWBK60161331926819", KEY)
    assert pii_surrogates._mod97(iban[:2], iban[4:]) == int(iban[2:4])
    cycle = pii_surrogates._given_cycles(KEY)
    assert len(set(cycle.values())) == len(cycle) and all(a != b for a, b in cycle.items())


def test_surrogates(spark):
    text = "Mail Bob.Smith@Mail7.example.com, bob.smith@mail7.example.com; +1 (980) 555-6268 or +1-980-555-6268. Mr. John Miller met Anna Petrova. ANNA left. Анна Иванова, Иван Иванов."
    docs = spark.createDataFrame([(1, text), (2, "John Miller wrote"), (3, None), (4, ""), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii_surrogates.replace_entities(docs, KEY).collect()}
    new = out[1].text
    for gone in ("Bob", "bob", "6268", "John", "Miller", "Petrova", "Anna", "ANNA", "Иванов"):
        assert gone not in new
    mentions = out[1].entities
    emails = [m.surrogate for m in mentions if m.kind == "email"]
    assert emails[0].lower() == emails[1] and emails[0] != emails[1]
    phones = ["".join(filter(str.isdigit, m.surrogate)) for m in mentions if m.kind == "phone"]
    assert phones[0] == phones[1] and phones[0][0] == "1"
    names = [m.surrogate for m in mentions if m.kind in ("given", "surname")]
    assert out[2].text == f"{names[0]} {names[1]} wrote"  # the same person in another document
    given = {n: g for n, g in pii_surrogates._GENDERS.items()}
    assert given[names[0]] == ("latin", "m") and given[names[2]] == ("latin", "f") and names[4] == names[2].upper()
    assert names[6].startswith(names[8][:-2]) and names[6].endswith("ова") and names[8].endswith("ов")  # one family, two genders
    assert out[3].text is None and out[4].text == ""
    for m in mentions:
        assert new[m.new_start : m.new_start + len(m.surrogate)] == m.surrogate


def test_surrogate_collisions_move_on(spark):
    first = pii_surrogates.surrogate("national", "123-45-6789".replace("-", ""), KEY)
    real = f"{first[:3]}-{first[3:5]}-{first[5:]}"  # the surrogate of one entity is another entity of the input
    docs = spark.createDataFrame([(1, "no 123-45-6789 here"), (2, f"no {real} here")], "doc_id long, text string")
    entities = pii_surrogates.distinct_entities(docs)
    moved = {r.entity: r.tweak for r in pii_surrogates.exceptions(entities, KEY).collect()}
    assert moved.get("123456789", 0) >= 1
    out = {r.doc_id: r.text for r in pii_surrogates.replace_entities(docs, KEY).collect()}
    assert real not in out[1] and out[1] != out[2]


def test_surrogate_exceptions_by_join(spark, monkeypatch):
    first = pii_surrogates.surrogate("national", "123456789", KEY)
    real = f"{first[:3]}-{first[3:5]}-{first[5:]}"
    docs = spark.createDataFrame([(1, "no 123-45-6789 here"), (2, f"no {real} here")], "doc_id long, text string")
    want = {r.doc_id: r.text for r in pii_surrogates.replace_entities(docs, KEY).collect()}
    monkeypatch.setattr(pii_surrogates, "MOST_BROADCAST", 0)
    assert {r.doc_id: r.text for r in pii_surrogates.replace_entities(docs, KEY).collect()} == want


@pytest.mark.parametrize("most", [pii_surrogates.MOST_BROADCAST, 0])
def test_surrogates_equal_brute_force(spark, monkeypatch, most):
    """Null and repeated ids, repeated rows, clashing columns, a very long text; on either side of the broadcast's bound."""
    monkeypatch.setattr(pii_surrogates, "MOST_BROADCAST", most)
    first = pii_surrogates.surrogate("national", "123456789", KEY)
    real = f"{first[:3]}-{first[3:5]}-{first[5:]}"
    rng = random.Random(6)
    bits = ["no 123-45-6789 here", f"no {real} here", "Mr. John Miller met Anna Petrova", "ask Bob.Smith@mail7.example.com", "call +1 (980) 555-6268.", "plain words", "Dear Priya Raghunathan"]
    rows = [(rng.choice([None, 1, 2, k]), "; ".join(rng.choices(bits, k=rng.randint(1, 5)))) for k in range(60)]
    rows += [(None, bits[0]), (None, bits[1]), (None, None), (7, ""), (8, "pad " * 50_000 + bits[0])] + [(9, bits[0])] * 3
    docs = spark.createDataFrame([(i, t, "e", "k", 1) for i, t in rows], "doc_id long, text string, entities string, kind string, _id int").repartition(4)
    # brute force: every entity of every text; the tweak of each raised until its surrogate is no entity and nobody else's
    known = sorted({(k, pii_surrogates.canonical(k, t[s:e], g)) for _, t in rows if t for s, e, k, g in pii_surrogates.find_entities(t)})
    tweak = dict.fromkeys(known, 0)
    while True:
        made = {n: pii_surrogates.surrogate(*n, KEY, w) for n, w in tweak.items()}
        owners = {}
        for n in known:
            owners.setdefault((n[0], made[n]), []).append(n)
        bad = [n for n in known if n[0] != "given" and ((n[0], made[n]) in tweak or owners[n[0], made[n]][0] != n)]
        if not bad:
            break
        for n in bad:
            tweak[n] += 1
    assert any(tweak.values())

    def rewritten(text):
        if text is None:
            return None
        out, at = "", 0
        for s, e, kind, gender in pii_surrogates.find_entities(text):
            mention = text[s:e]
            out += text[at:s] + pii_surrogates.render(kind, mention, made[kind, pii_surrogates.canonical(kind, mention, gender)], gender)
            at = e
        return out + text[at:]

    got = pii_surrogates.replace_entities(docs, KEY).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((i, rewritten(t)) for i, t in rows), key=str)
    assert not any(real in (r.text or "") and "123-45-6789" in (r.text or "") for r in got)
    assert pii_surrogates.replace_entities(docs.limit(0), KEY).count() == 0


PEOPLE = ["Priya Raghunathan", "Wei Zhang", "Kwame Mensah", "Oluwaseun Adeyemi", "Nguyen Thi Hoa", "Aoife Brennan", "Yusuf Demir", "Ingeborg Haraldsen", "Mateusz Kowalczyk", "Siobhan Gallagher"]
FRAMES = ["Yesterday {} met the committee.", "I was told that {} wrote the letter.", "My name is {}.", "Dear {}, thank you.", "Dr {} agreed.", "the author {} spoke.", "She met {} and {} there.", "Mrs. {} left.", "Hier {} habite Lyon.", "Gestern traf {} ein."]


def test_names_beyond_the_lists():
    found = total = 0
    for k, frame in enumerate(FRAMES):
        for j, person in enumerate(PEOPLE):
            other = PEOPLE[(j + 1) % len(PEOPLE)]
            text = frame.format(person, other) if frame.count("{}") == 2 else frame.format(person)
            spans = [text[s:e] for s, e, kind, _ in pii_surrogates.find_entities(text) if kind in ("given", "forename", "surname")]
            for name in [person] + [other] * (frame.count("{}") - 1):
                total += 1
                found += all(w in spans for w in name.split())
    assert found / total >= 0.85, found / total
    for clean in ("The The of Of Of in New York City.", "GNU General Public License said nothing", "On Monday Morning News Report came", "He called The Hague. It Is.", "A Day Like Any"):
        assert not [k for _, _, k, _ in pii_surrogates.find_entities(clean)], clean


def test_scripts_and_forms_of_names():
    new = lambda text: pii_surrogates.Replacer(KEY, {}).rewrite(text, {})[0]
    scripts = lambda text: [pii_surrogates.script_of(w) for w in text.split()]
    for text in ("Dr 王小明", "Dr Иванова", "Frau 김민수", "Prof. Παπαδόπουλος", "Dr דוד", "Mr احمد"):
        assert scripts(new(text)) == scripts(text) and new(text).split()[1] != text.split()[1]
    woman, man = new("Dr Иванова").split()[1], new("Dr Иванов").split()[1]
    assert woman == man + "а" and man.endswith("ов")
    assert new("Dr Достоевская").endswith("ая") and new("Anna Petrova").endswith("ova") and new("MR PETROV").split()[1].isupper()


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("at 24.243.215.198. Next", ["ip"]),
        ("v1.2.3.4.5 and 1.2.3", []),
        ("call 980-555-6268. Or (980) 555-6268, or +1 (980) 555-6268!", ["phone"] * 3),
        ("pay:4111111111111111,4111 1111 1111 1111. 0.4111111111111111", ["card"] * 2),
        ("id 123-45-6789. x 1123-45-6789", ["national"]),
        ("a@b @c.de x@y.z .dot@host.org. (p.q+r@sub.host.co.uk)", ["email"] * 2),
        ("IBAN GB29 NWBK 6016 1331 9268 19.", ["iban"]),
        ("anna and Mister X, Dr. No left. Laura", ["surname", "given"]),
        ("", []),
        ("1" * 10_000 + "@" * 2000, []),
    ],
)
def test_entities(text, kinds):
    assert [k for _, _, k, _ in pii_surrogates.find_entities(text)] == kinds
