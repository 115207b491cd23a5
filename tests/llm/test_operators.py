"""The training-data operators against brute force, and on odd rows: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from trawl.llm import chat, common, decontaminate, graph, html, langid, mixing, neardup, quality, queries, tokens, toxicity, wavelet  # noqa: E402
from trawl.llm.common import ASCII_LOWER, Memo, small_batches  # noqa: E402

SPM, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, _text string, copies int, rank double, cls long, score double, id string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
TEXTS = [
    None, "", " ", "\n", "one", "One two", "a b c d e f", "A B C D E F", "a b c d e f", "x" * 30_000, LONG, LONG + " end", "é̂ 日本 語　x", "</s> <|endoftext|> ▁▁ \x00 \x1c a", "  double  spaces ", "tab\tand\nlines\nlines\nlines",
    "the cat sat on the mat and the dog ran off", "the cat sat on the mat and the dog ran away", "<p>&amp;</p>", "12 34 !!",
]


def odd_rows():
    rows = [(i, t, ["en", None, "de"][i % 3], ["s", None, "t"][i % 3]) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here at all", None, None), (None, None, "en", "s"), rows[6], rows[6], (6, "another text of id six", "en", "s")]
    return [(*r, 0, "h", "clash", 9, 0.5, 7, 1.0, "x") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    small_batches(spark, 7)
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=repr)


# 1 ------------------------------------------------------------------------------------------------------------------


def wanted_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        rate = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if weight[s] * rate >= 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else weight[s] * rate for s in order}
        capped |= over


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    rows = mixing.mix(df).collect()
    size, source = Counter(), defaultdict(int)
    for r in df.select("doc_id", "text", "source").collect():
        size[(r[0], r[2], len(WORD.findall(r[1] or "")))] += 1
        source[r[2]] += len(WORD.findall(r[1] or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == size
    want = wanted_targets(source)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["source_size"] == source[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    again = mixing.mix(df.repartition(3)).collect()
    pick = lambda rs: key((r["doc_id"], r["source"], r["size"], r["taken"]) for r in rs)
    assert pick(again) == pick(rows)


def test_mixed_rows(odd, none):
    made = mixing.mixed(odd)
    assert made.columns == odd.columns
    want = mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert made.count() == want
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixing_chances_follow_importance(spark):
    rows = [(i, "a b c d", "s", 1.0 + (i % 2) * 3) for i in range(4000)] + [(9000 + i, "z " * 200, "t", 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    found = mixing.mix(df, share=0.4, importance="weight").where("source = 's'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("copies").alias("m")).collect()
    m = {r["odd"]: r["m"] for r in found}
    assert 2.5 < m[1] / m[0] < 6


# 2 and 6 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_counts(request, which):
    import sentencepiece

    df, model = request.getfixturevalue(which), sentencepiece.SentencePieceProcessor(model_file=SPM)
    want = key((i, len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096) for i, t in texts_of(df))
    assert key(map(tuple, tokens.token_counts(df, SPM).collect())) == want


def test_token_counts_empty(none):
    assert tokens.token_counts(none, SPM).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_files(request, which):
    from tokenizers import Tokenizer

    df, t = request.getfixturevalue(which), Tokenizer.from_file(BPE)
    want, at = [], 0
    hashed = lambda text: (xxhash.xxh64_intdigest(text.encode(), 42) + (1 << 63)) % (1 << 64)
    for i, text in sorted(texts_of(df), key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1]))):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert key(map(tuple, wavelet.encode(df, BPE).collect())) == key(want)


def test_token_files_empty(none):
    assert wavelet.encode(none, BPE).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [3, 3, 3], [0, 70_000, 5], list(np.random.default_rng(3).integers(0, 300, 5000))])
def test_wavelet_file(ids):
    ids = np.array(ids, "<u4")
    f = wavelet.WaveletFile(wavelet.build(ids, [4, None], [len(ids), 0]))
    assert (f.decode() == ids).all() and f.doc_ids == [4, None] and f.lengths.tolist() == [len(ids), 0]
    for i in range(0, len(ids), 97):
        assert f.access(i) == ids[i]
        assert f.count(int(ids[i])) == (ids == ids[i]).sum() and f.count(int(ids[i]), i, len(ids)) == (ids[i:] == ids[i]).sum()
        assert f.locate(int(ids[i])).tolist() == np.flatnonzero(ids == ids[i]).tolist()
        assert f.select(int(ids[i]), f.count(int(ids[i]), 0, i)) == i
    assert f.count(1 << 20) == 0 and f.locate(299_999).tolist() == []
    with pytest.raises(IndexError):
        f.select(1, (ids == 1).sum())
    with pytest.raises(IndexError):
        f.access(len(ids))


def test_word_table_forgets(monkeypatch):
    monkeypatch.setattr(wavelet, "TABLE_ROWS", 50)
    e, rng = wavelet.Encoder(BPE), random.Random(1)
    for _ in range(30):
        texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(20)) for _ in range(3)]
        want = [np.array(x.ids, "<u2").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert e.encode(texts) == want
    assert e.table.words < 150


def test_words_outside_the_table():
    """Texts without spaces leave nothing behind; words that share a key are told apart."""
    e, rng = wavelet.Encoder(BPE), random.Random(2)
    whole = lambda texts: [np.array(x.ids, "<u2").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(20):
        texts = ["a " + " ".join("".join(rng.choices("日本語のテキスト", k=400)) for _ in range(5)) for _ in range(5)]
        assert e.encode(texts) == whole(texts)
    assert e.table.used < 10 and len(e.table.pool) < 1 << 17
    e._keys = lambda data, start, n: (np.zeros(len(n), np.uint64), wavelet.Encoder._keys(e, data, start, n)[1])
    for texts in (["x one two", "y two three one"], ["z three three four two"]):
        assert e.encode(texts) == whole(texts)


def test_token_files_need_whole_ids(spark):
    with pytest.raises(TypeError):
        wavelet.encode(spark.createDataFrame([("a", "x")], "doc_id string, text string"), BPE)


# 3 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("part", [1, 2, 3, 1024])
def test_marginals_against_all_paths(monkeypatch, part):
    monkeypatch.setattr(toxicity, "PART", part)
    rng = np.random.default_rng(1)
    scores, sizes, moves = rng.normal(size=9), np.array([4, 0, 5]), tuple(rng.normal(size=4))
    got, expected = toxicity.marginals(scores, sizes, moves, pairs=True)
    want, pairs, at = [], np.zeros(4), 0
    for n in sizes:
        if n:
            total, p, q = 0.0, np.zeros(n), np.zeros(4)
            for path in range(2**n):
                y = [path >> k & 1 for k in range(n)]
                w = np.exp(sum(scores[at + k] for k in range(n) if y[k]) + sum(moves[2 * a + b] for a, b in zip(y, y[1:])))
                total += w
                p += w * np.array(y)
                for a, b in zip(y, y[1:]):
                    q[2 * a + b] += w
            want += (p / total).tolist()
            pairs += q / total
        at += n
    assert np.allclose(got, want) and np.allclose(expected, pairs)


def test_marginals_of_long_texts(monkeypatch):
    rng = np.random.default_rng(2)
    scores, sizes, moves = rng.normal(size=20_000) * 5 - 4, np.array([0, 3, 15_000, 1, 4_996, 0]), (0.7, -2.0, -1.5, 1.1)
    cut, n_cut = toxicity.marginals(scores, sizes, moves, pairs=True)
    monkeypatch.setattr(toxicity, "PART", 1 << 20)
    whole, n_whole = toxicity.marginals(scores, sizes, moves, pairs=True)
    assert np.allclose(cut, whole) and np.allclose(n_cut, n_whole)


def brute_score(model, text):
    """Forward and backward sums word by word, then the curve."""
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", text.replace("İ", "i"))]
    x = [0.0, 0.0, 0.0]
    if words:
        e = [np.exp(np.clip(model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(w)), -30, 30)) for w in words]
        t = np.exp(np.array(model.moves)).reshape(2, 2)
        forward = [np.array([1.0, e[0]])]
        for v in e[1:]:
            a = forward[-1] @ t * [1.0, v]
            forward.append(a / a.sum())
        backward = [np.ones(2)]
        for v in reversed(e[1:]):
            b = t @ (backward[-1] * [1.0, v])
            backward.append(b / b.sum())
        p = [(a * b)[1] / (a * b).sum() for a, b in zip(forward, reversed(backward), strict=True)]
        x = [np.log1p(sum(p)), max(p), (sum(p) / len(p)) ** 0.5]
    return 1 / (1 + np.exp(-(model.curve[0] + np.dot(model.curve[1:], x))))


def toxic_corpus(n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = [rng.choice(words) for _ in range(60)]
        for _ in range(5 * bad):
            text[rng.randrange(60)] = rng.choice(["vile", "rotten", "Foul"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None), labels[3]], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    found = {r["doc_id"]: r for r in toxicity.score(df, model, spans=True).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i]["held_out"] == (i in set(held)) for i in truth)
    assert sum(found[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    text = dict(rows)
    marked = {text[i][s["start"] : s["end"]].lower() for i in truth for s in found[i]["spans"]}
    assert marked and all(set(m.split()) <= {"vile", "rotten", "foul"} for m in marked)
    assert all(found[i]["score"] == pytest.approx(brute_score(model, text[i]), abs=1e-9) for i in truth)
    # odd rows, by a fitted field: null, empty, very long and repeated texts, and a letter that lower case makes two of
    odd = [(1, None), (2, ""), (3, "12 !"), (4, "word vile " * 40_000), (4, "word vile " * 40_000), (None, "İ hate rotten, vile İ")]
    got = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), model, spans=True).collect()
    assert [r["score"] for r in got] == [pytest.approx(brute_score(model, t or ""), abs=1e-9) for _, t in odd]
    assert "İ hate rotten, vile İ"[got[5]["spans"][0]["start"] : got[5]["spans"][-1]["end"]] == "rotten, vile"
    assert got[3] == got[4] and len(got[3]["spans"]) >= 1


def test_toxicity_sample(spark, monkeypatch):
    """A very long plain text doesn't crowd out others; an id of many rows is one document."""
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 3000)
    monkeypatch.setattr(toxicity, "LONG_CHARS", 1000)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append((texts, toxic)))
    rows = [(0, "plain " * 5000), (1, "x"), *((1, f"y{i}") for i in range(500)), *((i, f"words {i} " * 20) for i in range(2, 60))]
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    (texts, toxic), *_ = seen
    for y in (0, 1):
        mine = [t for t, z in zip(texts, toxic, strict=True) if z == y]
        assert len(mine) > 10 and sum(map(len, mine)) <= 3000
    assert sum(t[0] in "xy" for t in texts) <= 1


def test_toxicity_odd(spark, odd, none):
    empty = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.score(odd, empty).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert toxicity.score(none, empty).count() == 0


# 4 ------------------------------------------------------------------------------------------------------------------


def base_measures(text):
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += line in seen and WORD.search(line) is not None
        seen.add(line)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality(request, which):
    df = request.getfixturevalue(which)
    rows = quality.judge(df).collect()
    assert key(tuple(r)[:-1] for r in rows) == key((i, *base_measures(t)) for i, t in texts_of(df))
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_quality_adapts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(300):
        code = i % 2
        text = [word() + ("#" if code and rng.random() < 0.5 else "") for _ in range(120)]
        if i in (10, 20):  # symbols where the source has none
            text = [w + "###" for w in text]
        rows.append((i, " ".join(text), "en", "code" if code else "prose"))
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, k in kept.items() if not k} == {10, 20}


def test_quality_follows_upper_quantiles(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(8))
    rows = []
    for i in range(200):
        verse = i % 2
        lines = [" ".join(word() for _ in range(15)) for _ in range(7)]
        again = rng.randint(0, 3) if verse else 3 * (i == 10)  # of 10 lines; the other source has none
        for k in range(3):
            lines.insert(2 * k, "la" if k < again else word())
        rows.append((i, "\n".join(["la", *lines]), "en", "verse" if verse else "prose"))
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, k in kept.items() if not k} == {10}


def test_quality_empty(none):
    assert quality.judge(none).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------

PAGES = {
    "<body><div class=sidebar>x y z.</div><div class=content><h1>T</h1><p>Long para one, with text. And so on.</p><ul><li>item a</li></ul></div><div id=comments><p>Nice, post. Very good, all of it is so good.</p></div></body>": "T Long para one, with text. And so on. item a",
    "<article><h1>T &amp; U</h1><div class='notice'>We use cookies, ok.</div><p>Body\n of  it.</p><aside>x</aside><p>Be <a href=x>li</a>nk.</p><section class='comments'><p>c</p></section><form><p>send</p></form></article>": "T & U Body of it. Be link.",
    "<script>var t='</p>';</script><style>p{}</style><nav><a href=/>Home</a></nav><main><p>a<p>b<br>c</main><footer>f</footer>": "a b c",
    "": "", "<p>": "", "plain": "plain", "<a <b": "", "<p>1 < 2</p>": "1 < 2", "<nav>only</nav>": "", "<p title=don't>x</p><p>y</p>": "x y",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_main_text(page):
    assert html.main_text(page) == PAGES[page]


LONG_PART = "Long text, it goes on. " * 40
WHOLE = {
    # content paths outside the element with most of the text
    f"<body><div class=top><a href=/>Home</a></div><div id=post><div class=text><p>{LONG_PART}</p></div><div class=text><p>Short end, of it.</p></div></div></body>": f"{LONG_PART}Short end, of it.",
    # links inside the article
    "<article><h1>T</h1><h2><a href=#s>Section title</a></h2><p>Body text, of it. More.</p><p><a href=x>One linked paragraph</a></p><ul><li><a href=y>Ref one</a></li><li><a href=z>Ref two</a></li></ul></article>": "T Section title Body text, of it. More. One linked paragraph Ref one Ref two",
    "<body><ul><li><a href=x>Home</a></li></ul><h1><a href=#t>T</a></h1><p>Text, it is.</p><h2>References</h2><ul><li><a href=x>Ref</a></li></ul></body>": "T Text, it is. References Ref",
    "<body><ul><li><a href=x>Home</a></li></ul></body>": "",
    # names of furniture on wrappers and parts of the article
    "<body><div class='main has-sidebar'><h1>T</h1><p>Body text, of it. More.</p><div class=sidebar>Side, bar.</div></div></body>": "T Body text, of it. More.",
    "<body><div class='page widget'><p>Body text, of it. More and more.</p><div class=sidebar>Side, bar.</div></div><p>by X</p></body>": "Body text, of it. More and more. by X",
    "<article><div class=post-header><h1><a href=x>Title</a></h1></div><p>Body text, of it. More.</p><section id=related-work><h2>Related work</h2><p>Others did, too.</p></section><h2 id=search>Search</h2><p>We search, much.</p><section id=discussion><p>We discuss, it.</p></section><div class=related><h3>More</h3><ul><li><a href=x>Other post</a></li></ul></div><div id=comments><p>No, no.</p></div></article>":
        "Title Body text, of it. More. Related work Others did, too. Search We search, much. We discuss, it.",
    f"<body><article><h1>T</h1><p>Short, one.</p></article><div class=ad>{LONG_PART}</div></body>": "T Short, one.",
}


@pytest.mark.parametrize("page", list(WHOLE))
def test_main_text_is_whole(page):
    assert html.main_text(page) == WHOLE[page]


def test_html_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    import html as decode

    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = (" ".join(decode.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article))
        assert got[r["page_id"]] == " ".join(filter(None, parts))


@pytest.mark.parametrize("tag", ["div", "div class=content", "section"])
def test_pages_without_article(spark, sf_dir, tag):
    """The tag paths alone find the same text."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        other = r["html"].replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>")
        assert "article" not in other.lower() or "<article" not in other
        assert html.main_text(other) == html.main_text(r["html"])


def test_names_only_lower_a_ratio():
    assert html.main_text(f"<body><div class='story share-price-report'><h1>T</h1><p>{LONG_PART}</p></div></body>") == f"T {LONG_PART.strip()}"
    assert html.main_text(f"<article><h1>T</h1><p>{LONG_PART}</p><p class=search>Search me, here.</p></article>") == f"T {LONG_PART}Search me, here."
    assert html.main_text(f"<article><p>{LONG_PART}</p><section class='user-responses'><p>Great, post. So good.</p></section></article>") == LONG_PART.strip()


HOSTILE = {
    "tags without end": "<a " * 350_000, "deep": "<div>" * 100_000 + "x", "deep with text": "<div>x" * 50_000, "open quotes": "<a \"><a '>" * 100_000, "quotes that hold ends": '<a ">"' * 150_000, "declarations": "<!" * 400_000,
    "names": "<div class=ad>" * 50_000 + "x", "parts of lists": "<div>" * 50_000 + "<dd>x</dd>" * 50_000, "ends of nothing": "<div>" * 50_000 + "</x>" * 100_000, "signs": "<" * 500_000, "comments": "<!--" * 200_000, "paragraphs": "<x>" * 50_000 + "<p>x" * 50_000,
}


@pytest.mark.parametrize("name", list(HOSTILE))
def test_hostile_pages_take_linear_time(name):
    import time

    began = time.process_time()
    html.main_text(HOSTILE[name])
    assert time.process_time() - began < 5


def test_html_odd(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>x</p>", "t"), (1, None, None, "t")], "page_id long, url string, html string, text string")
    assert key(map(tuple, html.extract(df).collect())) == key([(1, None, "", 0), (None, "u", "x", 1), (1, None, "", 0)])
    assert html.extract(df.limit(0)).count() == 0


# 7 ------------------------------------------------------------------------------------------------------------------


def brute_hits(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = tuple(word.findall((t or "").translate(ASCII_LOWER)))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[w[k : k + 13]].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = tuple(word.findall((t or "").translate(ASCII_LOWER))), set(), set()
        for m in {len(x) for x in windows}:
            for p in range(len(w) - m + 1):
                if w[p : p + m] in windows:
                    hit.update(range(p, p + m))
                    found |= windows[w[p : p + m]]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return key(out)


@pytest.mark.parametrize("block", [10**6, 15])
def test_decontamination(spark, odd, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items = [(1, "the"), (2, "b C"), (3, ""), (4, None), (10, " ".join(f"w{i}" for i in range(5, 40))), (5, "the dog"), (5, "x y"), (12, "é̂ 日本 語　x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert key(tuple(r)[:6] for r in decontaminate.annotate(odd, bench).collect()) == brute_hits(texts_of(odd), items)
    clean = decontaminate.clean(odd, bench)
    assert clean.columns == odd.columns
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    hit = Counter((r[0], r[1]) for r in rows if brute_hits([r], items)[0][2])
    assert Counter((r["doc_id"], r["text"] or "") for r in clean.collect()) == Counter(rows) - hit


def test_clean_keeps_columns(spark):
    bench = spark.createDataFrame([(1, "so long a passage")], "item_id long, text string")
    rows = [(1, 5, "x", "some so long a passage of it " + "word " * 500, 1.5), (2, 6, "y", "clean", 2.5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, _n_words int, _contaminated string, text string, `a b` double")
    assert [tuple(r) for r in decontaminate.clean(df, bench).collect()] == rows[1:]


def test_decontamination_tables(spark, sf_dir, docs):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert key(tuple(r)[:6] for r in decontaminate.annotate(docs, bench).collect()) == brute_hits(texts_of(docs), [tuple(r) for r in bench.select("item_id", "text").collect()])


def test_longest_matches(spark):
    text = "x " + " ".join(f"w{i}" for i in range(60)) + " y " + " ".join(f"w{i}" for i in range(5, 20))
    rows = [(1, text), (2, "a " * 3000), (3, "nothing of it")]
    bench = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(5, 40))), (8, "a " * 2000), (9, "y w5")], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.annotate(spark.createDataFrame(rows, "doc_id long, text string"), bench, matches=True).collect()}
    assert [m.asDict() for m in found[1]["matches"]] == [{"item": "7", "doc_word": 6, "item_word": 0, "n_words": 35}, {"item": "9", "doc_word": 61, "item_word": 0, "n_words": 2}]
    assert (found[1]["longest"], found[1]["longest_at"]) == (35, 6)
    assert [m.asDict() for m in found[2]["matches"]] == [{"item": "8", "doc_word": 0, "item_word": 0, "n_words": 2000}]  # a text that repeats itself
    assert (found[3]["longest"], found[3]["longest_at"], found[3]["matches"]) == (0, None, [])


def test_longest_matches_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("ab")
    items = [(str(i), [word() for _ in range(rng.randint(10, 60))]) for i in range(6)]
    texts = [[word() for _ in range(200)] + items[i % 6][1] + [word() for _ in range(50)] for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.annotate(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, text string"), matches=True).collect()}
    for i, t in enumerate(texts):
        want = {}
        for name, w in items:
            least = min(13, len(w))
            for a in range(len(t)):
                for b in range(len(w)):
                    n = 0
                    while a + n < len(t) and b + n < len(w) and t[a + n] == w[b + n]:
                        n += 1
                    if n >= least and n > want.get(name, 0):
                        want[name] = n
        assert {m["item"]: m["n_words"] for m in got[i]["matches"]} == want and got[i]["longest"] == max(want.values())
        assert all(t[m["doc_word"] : m["doc_word"] + m["n_words"]] == dict(items)[m["item"]][m["item_word"] : m["item_word"] + m["n_words"]] for m in got[i]["matches"])


def test_decontamination_empty(spark, odd, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.annotate(odd, bench).where("contaminated").count() == 0
    assert decontaminate.annotate(none, bench).count() == 0


# 8 ------------------------------------------------------------------------------------------------------------------


def test_language(docs):
    model = langid.train(docs)
    found = {r["doc_id"]: r for r in langid.detect(docs, model).collect()}
    rows = docs.collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and all(found[r["doc_id"]]["held_out"] for r in held)
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_odd(odd, none, docs):
    model = langid.train(docs)
    rows = langid.detect(odd, model).collect()
    assert len(rows) == odd.count()
    text = defaultdict(set)
    for i, t in texts_of(odd):
        text[i].add(t)
    for r in rows:
        letters = {any(c.isalpha() for c in t) for t in text[r["doc_id"]]}
        assert (r["lang_pred"] != "und") in letters and (r["lang_pred"] != "und" or r["score"] == 0)
    kept = langid.detect(odd, model, keep=True)
    assert kept.columns == [*odd.columns, "_lang_pred", "_lang_score"]
    assert langid.detect(none, langid.train(none)).count() == 0
    assert {r["lang_pred"] for r in langid.detect(odd, langid.fit({})).collect()} == {"und"}


def test_backoff():
    model = langid.fit({"b": Counter(quap=3, dren=3), "a": Counter(zork=3, blim=3)}, least=2)
    assert "zork" in model.words.rows and "zorkish" not in model.words.rows
    langs, shares = langid.predict(model, Memo(10), ["zorkish", "quapper", "zork quap quap", "1 2", "² ½Ⅷ _", "zork quap"])
    assert langs == ["a", "b", "b", "und", "und", "a"]  # of equal evidence, the first
    assert shares[5] == pytest.approx(0.5)


def brute_language(counts, text, least=3):
    """Word first, then n-grams, as sums over plain dictionaries."""
    languages = sorted(counts)
    grams = {lang: Counter() for lang in languages}
    for lang in languages:
        for w, n in counts[lang].items():
            for size in range(1, 6):
                for i in range(len(w) + 3 - size):
                    if (g := f"^{w}$"[i : i + size]) not in "^$":
                        grams[lang][g] += n

    def logs(table):
        known = {x for x, n in sum(table.values(), Counter()).items() if n >= least}
        size = {lang: sum(n for x, n in table[lang].items() if x in known) + 0.2 * max(1, len(known)) for lang in languages}
        return {x: [np.log((table[lang][x] + 0.2) / size[lang]) for lang in languages] for x in known}

    words, parts = logs(counts), logs(grams)
    found = [w for w in re.findall(r"[^\W\d_]+", text.lower()) if any(map(str.isalpha, w))]
    if not found or not languages:
        return "und", 0.0
    total = np.zeros(len(languages))
    for w in found:
        if w in words:
            total += words[w]
            continue
        held = f"^{w}$"
        hits = [next((parts[g] for k in range(min(5, len(held) - i), 0, -1) if (g := held[i : i + k]) in parts), None) for i in range(len(held))]
        hits = [h for h in hits if h is not None]
        if hits:
            total += np.mean(hits, axis=0)
    odds = np.exp((total - total.max()) / len(found) ** 0.5)
    return languages[int(total.argmax())], odds.max() / odds.sum()


def test_language_against_brute_force(docs, odd, monkeypatch):
    monkeypatch.setattr(langid, "SUMMED", 50)
    held = [r for r in docs.collect() if r["lang"] is not None and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    counts = defaultdict(Counter)
    for r in held:
        counts[r["lang"]].update(re.findall(r"[^\W\d_]+", r["text"].lower()))
    model = langid.train(docs)  # the table is smaller than the sample
    for df in (docs.limit(40), odd):
        text = defaultdict(list)
        for i, t in texts_of(df):
            text[i].append(brute_language(counts, t))
        for r in langid.detect(df, model).collect():
            assert any(r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=2e-3) for lang, score in text[r["doc_id"]])


def test_rare_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 0)
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 1000)
    rows = [(i, "one two three four five six seven " * 20, "en") for i in range(200)] + [(1000 + i, "eins zwei drei vier " * 30_000, "de") for i in range(6)] + [(2000 + i, "uno dos tres " * 3, f"x{i:03d}") for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == {g for i, _, g in rows if zlib.crc32(str(i).encode()) % 4 != 2} and len(model.languages) > 200
    assert langid.predict(model, Memo(10), ["zwei drei vier"])[0] == ["de"]


def test_confident_keeps_columns(spark, docs):
    rows = spark.createDataFrame([(1, "the cat sat on the mat", 1.0, "a", 3), (2, "12", 1.0, "b", 3), (3, None, 1.0, "c", 3)], "doc_id long, text string, _lang_score double, _lang_pred string, `a b` int")
    assert [tuple(r) for r in langid.confident(rows, langid.train(docs), 0.0).collect()] == [(1, "the cat sat on the mat", 1.0, "a", 3)]


# 9 ------------------------------------------------------------------------------------------------------------------


def conversation_digests(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = []
    for c, rs in by.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rs)
        loss = "".join(r[3] or "" for r in rs if r[2] == "assistant")
        out.append((c, len(rs), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return key(out)


CHATS = [
    (1, 0, "system", "be <|turn|> &lt; [x]"), (1, 1, "user", None), (1, 2, "assistant", "<|end|>\n&amp;amp;&&lt;"), (1, 2, "assistant", "b\n"), (None, 1, None, "a"), (None, None, "assistant", ""),
    (2, 5, "assis[tant\nx".replace("\n", " "), "q"), (2, 5, "assistant", "w" * 9000), (2, 6, "assistant", "😀é\n\n"), (2, 6, "assistant", "😀é\n\n"), (3, 0, "system", ""), (4, 0, "assistant", " </s>[INST] "),
]


@pytest.mark.parametrize(("span", "history_tokens", "history"), [(1536, 512, 2), (5, 9, 2), (20, 0, 0), (1, 1000, 4)])
def test_chat(spark, span, history_tokens, history):
    df = chat.with_check(spark.createDataFrame([(*r, "x") for r in CHATS], "conv_id long, turn long, role string, text string, window string"))
    made = chat.windows(df, span, history_tokens, history)
    got = chat.read_back(made)
    assert key(tuple(r)[:5] for r in got.collect()) == conversation_digests([tuple(r) for r in df.collect()])
    for r in made.collect():
        assert r["formatted"].count("<|turn|>") == r["formatted"].count("<|end|>") and "</s>" not in r["formatted"] and "[INST]" not in r["formatted"]


def test_chat_tables(spark, sf_dir):
    df = chat.with_check(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    got = queries.op9_chat_windows(spark, sf_dir).collect()
    assert key(tuple(r)[:5] for r in got) == conversation_digests([tuple(r) for r in df.collect()])
    assert chat.windows(df.limit(0)).count() == 0


def test_chat_keeps_its_budget(spark):
    tokens = lambda s: -(-(2 * len(s) + 3 * (len(s.encode()) - len(s))) // 8)
    rng = random.Random(3)
    rows = []
    for c, system in enumerate(("rules", "x" * 40_000, "規" * 9000, "[<&" * 3000, "😀" * 2000, None)):
        rows += [(c, 0, "system", system)] if system else []
        rows += [(c, k, ["assistant", "user"][k % 2], rng.choice("a規é<") * rng.choice([3, 40, 400, 1500]) + str(k)) for k in range(1, 60)]
    rows.append((7, 1, "user", "long " * 50_000))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(df).collect()
    for r in made:
        turns = [f"<|turn|>{t}" for t in r["formatted"].split("<|turn|>")[1:]]
        own = sum(map(tokens, turns[r["repeated"] :]))
        assert own <= chat.SPAN or len(turns) == r["repeated"] + 1
        assert sum(map(tokens, turns[: r["repeated"]])) <= chat.HISTORY_TOKENS + chat.SYSTEM_TOKENS
        if r["conv_id"] < 5 and r["window"] > 1:
            assert turns[0].startswith("<|turn|>system\n") and turns[0].endswith("<|end|>")
    assert key(tuple(r)[:5] for r in chat.read_back(chat.windows(df)).collect()) == conversation_digests(rows)


def test_chat_repeats_system_and_history(spark):
    rows = [(1, 0, "system", "rules"), *((1, k, ["assistant", "user"][k % 2], f"turn number {k} " + "x" * 40) for k in range(1, 9))]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), span=30, history_tokens=20, history=2).orderBy("window").collect()
    assert len(made) > 2 and all(r["formatted"].startswith("<|turn|>system\nrules<|end|>") for r in made)
    later = [r for r in made if r["window"] > 2]
    assert later and all(1 <= r["repeated"] <= 3 for r in later) and max(r["repeated"] for r in later) == 2


# 10 -----------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall(text.translate(ASCII_LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return key((d, len(sets[i]), c := (least.get(root(i)) if sets[i] else d), d == c) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    assert key(map(tuple, neardup.find(df).collect())) == brute_components(texts_of(df))


def test_near_duplicates_of_a_group(spark, monkeypatch):
    """A large group of near copies around the limit, in small blocks, so that all paths are taken."""
    monkeypatch.setattr(neardup, "BLOCK", 20)
    monkeypatch.setattr(neardup, "MEMBERS", 15)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{i}_{k}" for k in range(90)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert key(map(tuple, neardup.find(df).collect())) == brute_components(rows)


def test_dedup(odd, none):
    kept = neardup.dedup(odd)
    assert kept.columns == odd.columns
    gone = {r["doc_id"] for r in odd.collect()} - {r["doc_id"] for r in kept.collect()}
    assert gone == {7, 8, 11} or gone == {7, 8, 11, 17}
    assert neardup.find(none).count() == 0 and neardup.dedup(none).count() == 0


def test_null_ids_and_ids_of_two_texts(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(words[:k])
    # sets of 56, 44 and 36 shingles: links at 44/56 and 36/44, none at 36/56
    rows = [(1, text(60)), (None, text(48)), (2, text(40)), (3, "some other text of one"), (None, "some other text of one"), (3, text(60)), (None, "alone and without any id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert key(map(tuple, neardup.find(df).collect())) == brute_components(rows)
    assert {r["component_id"] for r in neardup.find(df).collect() if r["doc_id"] == 2} == {1}  # by way of a null id
    assert key(map(tuple, neardup.dedup(df).collect())) == key([rows[0], rows[3], rows[6]])


def test_keys_guarantee():
    """Signatures that differ in no more than DISTANCE positions share a key."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, (1, neardup.POSITIONS)).astype(np.uint16)
        b = a.copy()
        b[0, rng.choice(neardup.POSITIONS, neardup.DISTANCE, replace=False)] ^= np.uint16(1)
        assert {*neardup.chunk_keys(a)[0].tolist()} & {*neardup.chunk_keys(b)[0].tolist()}


def test_only_distance_and_sizes_decide_confirmation():
    """Of sets with 3 of 4 shingles in common, all pairs under the distance are confirmed."""
    rng = np.random.default_rng(3)
    sets = [np.sort(x) for h in rng.integers(0, 2**63, (100_000, 4)).astype(np.uint64) for x in (h, h[:3])]
    made = neardup.signatures(sets)
    parts = made if isinstance(made, tuple) else (made,)
    fine = neardup.near_enough(*(side for p in parts for side in (p[::2], p[1::2])), np.full(100_000, 4), np.full(100_000, 3))
    assert (fine == ((parts[0][::2] != parts[0][1::2]).sum(axis=1) <= neardup.DISTANCE)).all()


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + k, 301 + k) for k in range(60)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in nodes}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_spread_join(spark, monkeypatch):
    """As a plain join; hot keys and rows without a key are dealt out."""
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = [(7, i) for i in range(500)] + [(None, i) for i in range(300)] + [(i % 40, i) for i in range(200)] + [(99, 0)]
    df = spark.createDataFrame(rows, "k long, v long")
    stats = df.where("k IS NOT NULL AND k <> 99").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    made = common.spread_join(df, stats, "k", "n", len(rows), "v")
    plain = df.join(stats, "k", "left").select("k", "v", "n", "least")
    assert made.columns == plain.columns and key(map(tuple, made.collect())) == key(map(tuple, plain.collect()))
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 700


def test_settled_tables_can_be_discarded(spark):
    import os

    kept, gone = common.settle(spark.range(5)), common.settle(spark.range(5))
    common.discard(gone)
    assert kept.count() == 5 and not os.path.exists(gone.settled_at.removeprefix("file:")) and os.path.exists(kept.settled_at.removeprefix("file:"))


# all ----------------------------------------------------------------------------------------------------------------


def test_queries_cover_all():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
