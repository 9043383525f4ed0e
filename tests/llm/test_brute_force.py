"""Operators against brute force on small fixtures, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from sievework.llm import bpe, common, decontaminate, html, langid, line_dedup, near_dup, quality, substrings, token_counts, urls

# nulls, empty and blank texts, ties, repeated rows, ids that repeat, extra columns with clashing names
EDGE = [
    (1, "a b c d e f g h i j k l\nsecond line of the text here", "en", "s", 5, "x"),
    (1, "a b c d e f g h i j k l\nsecond line of the text here", "en", "s", 5, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "s", 0, "x"),
    (4, " \t\n\r\n", "de", "s", 5, "y"),
    (5, "ñandú été ☃ 漢字 ０１", "es", None, 1, None),
    (None, "a b c d e f g h i j k l\nsecond line of the text here", "fr", "s", 1, None),
    (6, "x" * 30000 + " " + "word " * 20000, "en", "s", 1, None),
    (7, "two words", None, "s", 9, "z"),
]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SHAPE).withColumnsRenamed({"n_chars": "key"})


@pytest.fixture(scope="module")
def none(edge):
    return edge.limit(0)


def by_id(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=str)


def corpus(seed, n_groups=6, size=12, vocabulary=800):
    """Groups of near copies made by edits, and passages that documents share."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = [rnd.choice(words) for _ in range(50)]
    out = []
    for _ in range(n_groups):
        pool = [[rnd.choice(words) for _ in range(rnd.choice([4, 40, 120, 300]))]]
        for _ in range(size):
            v = list(rnd.choice(pool))
            for _ in range(max(1, int(len(v) * rnd.choice([0.005, 0.02, 0.04])))):
                i = rnd.randrange(len(v))
                v[i : i + rnd.choice([0, 1, 1])] = [rnd.choice(words)]
            if rnd.random() < 0.3:
                i = rnd.randrange(len(v))
                v[i:i] = passage
            pool.append(v)
        out += [" ".join(v[:50]) + "\n" + " ".join(v[50:]) for v in pool]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("least", [0, 5, 10**6])
def test_join_each(spark, least):
    """Hot keys by broadcast and others by shuffle make one join."""
    rows = [(k, i) for k, n in enumerate([0, 1, 2, 50, 300]) for i in range(n)] + [(99, 0), (None, 1)]
    each = spark.createDataFrame([(k, n, f"k{k}") for k, n in enumerate([0, 1, 2, 50, 300])], "k int, n long, name string")
    got = common.join_each(spark.createDataFrame(rows, "k int, i int"), each, ["k"], least=least)
    assert sorted((r.k, r.i, r.name) for r in got.collect()) == sorted((k, i, f"k{k}") for k, i in rows if k not in (99, None))


def test_near_dup(spark):
    texts = [*corpus(1), *corpus(2), "a b", "A  b", "c", "", None, "a b c", "x y z x y z"]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component, r.kept) for r in near_dup.group(df, shingle=3, percent=85).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}
    kept = near_dup.clean(df, shingle=3, percent=85)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in range(len(texts)) if find(i) == i)


def test_near_dup_ids(spark):
    """Null ids are linked too, an id joins the groups of all its texts, and one id on many texts is no cost."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("a") + " x"), (None, text("b")), (None, text("b") + " x"), (9, text("b") + " y"), (8, text("c")), (8, text("d")), (7, text("d") + " z"), (6, text("e"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.component, r.kept) for r in sorted(near_dup.group(df).join(df.withColumn("row_key", common.row_key(df.doc_id, df.text)).withColumnsRenamed({"doc_id": "own"}), "row_key").collect(), key=lambda r: rows.index((r.id, r.text)))]
    assert sorted(got[:2], key=str) == [(None, False), (None, True)] and got[2:] == [(9, False), (9, False), (9, True), (7, False), (7, False), (7, True), (6, True)]
    assert sorted(str(r.doc_id) for r in near_dup.clean(df).collect()) == ["6", "7", "9", "None"]


def test_near_dup_edges(edge, none):
    got = by_id(near_dup.group(edge), "id", "n_shingles", "component", "kept")
    assert (2, 0, 2, True) in got and (3, 0, 3, True) in got and (4, 0, 4, True) in got
    assert got.count((1, 14, 1, True)) == 2 and (None, 14, 1, False) in got
    assert len(got) == len(EDGE) and near_dup.group(none).count() == 0
    assert near_dup.clean(edge).columns == edge.columns
    assert [r.doc_id for r in near_dup.clean(edge).collect()].count(1) == 1


def test_odd_sketch_estimates():
    rnd = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.9):
        a = rnd.integers(0, 2**63, 2000).astype(np.uint64)
        b = np.concatenate([a[: int(2000 * share)], rnd.integers(0, 2**63, 2000 - int(2000 * share)).astype(np.uint64)])
        x, y = (np.frombuffer(near_dup.fold(near_dup.signature(s)), np.uint64) for s in (a, b))
        true = share / (2 - share)
        assert abs(near_dup.estimate(np.bitwise_count(x ^ y).sum()) - true) < near_dup.SLACK


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_banded_distance():
    rnd = random.Random(4)
    for _ in range(3000):
        a = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(12)))
        b = bytearray(a)
        for _ in range(rnd.randrange(5)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.choice([0, 1])] = bytes(rnd.choice(b"abc") for _ in range(rnd.choice([0, 1])))
        for tau in (0, 1, 2, 3):
            assert line_dedup.within(a, bytes(b), tau) == (distance(a, bytes(b)) <= tau), (a, b, tau)


@pytest.mark.parametrize("block", [2, line_dedup.BLOCK])
def test_line_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rnd = random.Random(5)
    bases = ["".join(rnd.choice("abcdé ") for _ in range(rnd.choice([10, 18, 25, 60]))) for _ in range(12)]
    docs = []
    for d in range(30):
        lines = []
        for _ in range(rnd.randrange(1, 6)):
            line = list(rnd.choice(bases))
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                i = rnd.randrange(len(line))
                line[i : i + rnd.choice([0, 1])] = [rnd.choice("abcd")] * rnd.choice([0, 1])
            lines.append(rnd.choice(["", " "]) + "".join(line))
        docs.append((d, "\n".join(lines)))
    first = {}
    for d, text in docs:
        for n, line in enumerate(text.split("\n")):
            key = line.encode().strip()
            if key:
                first.setdefault(key, (d, n))
    gone = {k for k in first if len(k) >= 16 and any(len(o) >= 16 and first[o] < first[k] and distance(o, k) <= 2 for o in first)}
    want = {}
    for d, text in docs:
        keys = [line.encode().strip() for line in text.split("\n")]
        want[d] = [n for n, k in enumerate(keys) if k and (k in gone or first[k] != (d, n))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: r.removed for r in line_dedup.duplicates(df).collect()}
    assert got == want and any(want.values())
    cleaned = {r.doc_id: r.text for r in line_dedup.clean(df).collect()}
    assert cleaned == {d: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[d]) for d, t in docs}


def test_line_dedup_hot_segment(spark):
    """Very many lines that share a third: pairs are made only of those that share more, and none is lost."""
    rnd = random.Random(15)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    lines = [("the same beginning: " + word(40)) for _ in range(6 * line_dedup.BLOCK)]
    near = {}
    for i in range(0, 600, 3):  # an edit or two behind the shared third, inside it, and one of each
        line = list(lines[i])
        for at in {0: [25, 50], 1: [3, 7], 2: [5, 40]}[i % 2 + (i % 5 == 0 and i % 2 == 0) * 2]:
            line[at : at + rnd.choice([0, 1])] = rnd.choice(["", "#"])
        near["".join(line)] = i
    docs = [(d, "\n".join(lines[d : d + 64])) for d in range(0, len(lines), 64)] + [(10**6 + k, x) for k, x in enumerate(near)]
    got = {r.id: r.removed for r in line_dedup.duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[d] == ([0] if d >= 10**6 else []) for d, _ in docs)


def test_line_dedup_edges(edge, none):
    got = by_id(line_dedup.duplicates(edge), "id", "n_lines", "removed")
    assert (2, 0, []) in got and (3, 0, []) in got and (4, 3, []) in got
    assert (None, 2, []) in got and got.count((1, 2, [0, 1])) == 2  # the null id comes first; repeated rows tie
    assert len(got) == len(EDGE) and line_dedup.duplicates(none).count() == 0
    assert line_dedup.clean(edge).columns == edge.columns and line_dedup.clean(edge).count() == len(EDGE)


@pytest.mark.parametrize(("hot", "size"), [(0, 35), (1, 35), (substrings.HOT, 35), (substrings.HOT, 200)])
def test_substrings(spark, hot, size):
    texts = [*corpus(6, 5, 8), *corpus(7, 5, 8), None, "", "one two " * 60, "a " * 34, "b " * 35, "c " * 36, *[" ".join(f"w{i}" for i in range(600))] * 2]
    docs = list(enumerate(texts)) + [(0, texts[0])]
    places = {}
    for k, (_, t) in enumerate(docs):
        w = (t or "").split()
        for i in range(len(w) - size + 1):
            places.setdefault(tuple(w[i : i + size]), []).append((k, i))
    want = []
    for k, (d, t) in enumerate(docs):
        w = (t or "").split()
        hit = {i + j for i in range(len(w) - size + 1) if len(places[tuple(w[i : i + size])]) > 1 for j in range(size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in hit)
        want.append((d, len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert by_id(substrings.dedup(df, hot=hot, window=size), "id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)


def test_suffix_automaton():
    rnd = random.Random(8)
    for _ in range(200):
        group = [[rnd.choice("ab") for _ in range(rnd.randrange(1, 9))] for _ in range(rnd.randrange(1, 5))]
        a = substrings.SuffixAutomaton()
        for g in group:
            a.add(g, 1)
        a.finish()
        text = lambda g: "".join(g)
        times = lambda s: sum(text(g)[i:].startswith(s) for g in group for i in range(len(g)))
        for g in group:
            want = [max((n for n in range(i + 2) if n == 0 or times(text(g)[i + 1 - n : i + 1]) > 1), default=0) for i in range(len(g))]
            assert list(a.statistics(g)) == want


def test_substrings_edges(edge, none):
    got = by_id(substrings.dedup(edge), "id", "n_words", "n_removed")
    assert (2, 0, 0) in got and (3, 0, 0) in got and (6, 20001, 20000) in got and (7, 2, 0) in got
    assert len(got) == len(EDGE) and substrings.dedup(none).count() == 0


def test_quality_edges(edge, none):
    got = by_id(quality.judge(edge), "id", "n_words", "word_chars", "base_failed", "kept")
    assert (2, 0, 0, True, False) in got and (5, 5, 13, True, False) in got
    assert len(got) == len(EDGE) and quality.judge(none).count() == 0
    assert quality.clean(edge).columns == edge.columns


def test_quality_line_frequency(spark):
    rnd = random.Random(9)
    line = "this is the notice that stands on every page of the host 2024"
    docs = [(i, line.replace("2024", str(2000 + i)) + "\n" + " ".join(str(rnd.random()) for _ in range(60 if i else 10)), "h") for i in range(30)]
    docs += [(100 + i, "\n".join([line] * 9 + [f"w{rnd.random()}" for _ in range(3)]), "h") for i in range(2)]
    docs.append((200, line + "\n" + " ".join(str(rnd.random()) for _ in range(60)), "other"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.id: (r.n_left, r.kept) for r in quality.judge(df, max_repeat=100).collect()}
    assert got[1] == (60, True) and got[0] == (10, False) and got[100] == (3, False) and got[200][1] and got[200][0] == 73
    cleaned = {r.doc_id: r.text for r in quality.clean(df, max_repeat=100).collect()}
    assert cleaned[1] == docs[1][1].split("\n")[1] and cleaned[200] == docs[-1][1]


def test_decontamination(spark, edge, none):
    items = spark.createDataFrame([(7, "A b C d e f g h i j K"), (70, "TWO... words"), (8, ""), (9, None)], "item_id long, text string")
    for bits in (decontaminate.SCREEN_BITS, 6):  # a bitmap that lets nearly all through changes nothing
        got = by_id(decontaminate.contaminated(edge, items, screen_bits=bits), "id", "n_words", "n_hit", "items", "contaminated")
        assert got.count((1, 18, 11, ["7"], True)) == 2 and (7, 2, 2, ["70"], True) in got and (2, 0, 0, [], False) in got
    assert len(got) == len(EDGE) and decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(edge, items.limit(0)).filter("contaminated").count() == 0
    assert sorted(str(r.doc_id) for r in decontaminate.clean(edge, items).collect()) == ["2", "3", "4", "5", "6"]
    assert decontaminate.clean(edge, items).columns == edge.columns


@pytest.mark.parametrize("bits", [6, decontaminate.SCREEN_BITS])
def test_decontamination_random(spark, bits):
    """Windows of all lengths over few words, against brute force; one word stands in most items and documents."""
    rnd = random.Random(16)
    word = lambda: rnd.choice(["the", "The,", "a", "b", "c", "d", "é", "x9"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 3, 4, 7, 12])))) for i in range(25)]
    docs = [(d, " ".join(rnd.choice([word(), rnd.choice(items)[1]]) for _ in range(rnd.randrange(12)))) for d in range(120)]
    want = []
    for d, t in docs:
        ws, hit, found = decontaminate.words(t.encode()), set(), set()
        for i, x in items:
            for w in decontaminate.windows(decontaminate.words(x.encode()), 5):
                at = [s for s in range(len(ws) - len(w) + 1) if tuple(ws[s : s + len(w)]) == w]
                hit |= {s + k for s in at for k in range(len(w))}
                found |= {str(i)} if at else set()
        want.append((d, len(ws), len(hit), sorted(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    got = decontaminate.contaminated(*(spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id"))), size=5, screen_bits=bits)
    assert sorted((r.id, r.n_words, r.n_hit, sorted(r["items"]), r.items_sha256) for r in got.collect()) == want


def reference_encoding():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, sf_dir, edge, none):
    tokenizer = reference_encoding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    docs = common.table(spark, sf_dir, "documents")
    for df in (docs, edge):
        want = []
        for r in df.collect():
            ids = tokenizer.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
        out = bpe.encode(df, keep=["doc_id"])
        assert by_id(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
        assert out.filter("not round_trip").count() == 0
        back = bpe.decode(out.select("doc_id", "ids"))
        assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((r.text or "").encode() for r in df.collect())
    assert bpe.encode(none).count() == 0


def test_bpe_pieces():
    tokenizer, codec = reference_encoding(), bpe.Codec(*map(str, bpe.default_vocabulary()))
    rnd = random.Random(10)
    texts = ["".join(rnd.choice("aé ☃th\n　e1中er 𝒳!'s") for _ in range(rnd.choice([0, 1, 5, 30, 400]))) for _ in range(500)] + ["ab" * 3000, "é" * 3000]
    ids, first = codec.encode(texts)
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == tokenizer.encode_ordinary(t)
    with pytest.raises(ValueError):
        codec.decode(np.array([50256]))


def test_token_counts(spark, sf_dir, edge, none):
    import public_tokenizers as P

    vocabulary = set(token_counts.sentencepieces(P.path("piece_bpe_32k.model")))
    longest = max(map(len, vocabulary))

    def greedy(word):
        rest, n = "▁" + word, 0
        while rest:
            for k in range(min(longest, len(rest)), 0, -1):
                if rest[:k] in vocabulary:
                    rest, n = rest[k:], n + 1
                    break
            else:
                return 0
        return n

    for df in (common.table(spark, sf_dir, "documents"), edge):
        want = []
        for r in df.collect():
            counts = [greedy(w.decode()) for w in (r.text or "").encode().split()]
            want.append((r.doc_id, len(counts), sum(counts) + counts.count(0), counts.count(0)))
        assert by_id(token_counts.count(df, keep=["doc_id"]), "doc_id", "n_words", "n_tokens", "n_unknown") == sorted(want, key=str)
    assert token_counts.count(none).count() == 0


def test_longest_match():
    rnd = random.Random(11)
    for _ in range(300):
        pieces = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 9))}
        a = token_counts.LongestMatch(pieces, mark="")
        for _ in range(20):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9)))
            rest, n = word, 0
            while rest and (k := max((k for k in range(1, 5) if rest[:k] in pieces and k <= len(rest)), default=0)):
                rest, n = rest[k:], n + 1
            assert a.length(word) == (0 if rest else n), (pieces, word)


def test_language_id(spark, sf_dir, edge, none):
    docs = common.table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    out = langid.query(spark, sf_dir.replace("sf0.001", "sf0.01")).join(docs, "doc_id")
    right = out.filter("held_out and lang_pred <> 'und'").selectExpr("avg(cast(lang_pred = lang as int))").first()[0]
    assert right > 0.97 and out.filter("score < 0 or score > 1").count() == 0
    model = langid.train(docs)
    got = by_id(langid.predict(edge, model, keep=["doc_id"]), "doc_id", "lang_pred", "score")
    assert (2, "und", 0.0) in got and (3, "und", 0.0) in got and (4, "und", 0.0) in got and len(got) == len(EDGE)
    assert langid.predict(none, model).count() == 0
    nothing = langid.train(none)
    assert {r.lang_pred for r in langid.predict(edge, nothing).collect()} == {"und"}


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>"</p>"</script></head><body class="has-sidebar">
    <header>Head</header><nav><ul><li>Home<li>More</ul></nav><div class="ad box">Buy</div><div id=cookie-notice>Accept</div>
    <article><h1>Title &amp; more</h1><p><b>First &eacute;&#233; para<br>line<p>Second <i>in</i>line</p><form><input> Name</form>
    <aside>Side</aside><ul><li>one<li>two</ul><section class="comments"><p>Nice!</p></section><!-- no --></article><footer>&copy; us"""
    own, _ = html.blocks(page)
    assert [t for k, t in own if k == 2] == ["Title & more", "First éé para line", "Second inline", "one", "two"]


def test_html_extraction(spark, sf_dir):
    import html as entities

    pages = common.table(spark, sf_dir, "pages")
    got = {r.page_id: r.text for r in html.query(spark, sf_dir).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def test_html_hosts(spark):
    """Pages without an article: what the host's pages share goes, unique runs stay; any number of shards."""
    page = lambda i: f"<div>Home About Contact our friends and partners Login</div><div><p>{' '.join(f'u{i}x{k}' for k in range(9))}</p><p>second para x{i}</p></div><div>Copyright by the people of the web all rights reserved</div>"
    rows = [(str(i), f"http://h.x/{i}", page(i)) for i in range(24)] + [("n", None, None), ("e", "x", ""), ("e", "x", "")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    for shard in (8, 400):
        got = html.extract(df, shard_pages=shard).collect()
        texts = {r.id: r.text for r in got}
        assert len(got) == len(rows) and texts["n"] == texts["e"] == ""
        assert all(f"u{i}x1 u{i}x2" in texts[str(i)] and f"x{i}" in texts[str(i)] and "Copyright" not in texts[str(i)] and "Login" not in texts[str(i)] for i in range(24))
    assert html.extract(df.limit(0)).count() == 0


def test_repeated_runs():
    rnd = np.random.default_rng(12)
    for _ in range(100):
        pages = [list(rnd.integers(0, 3, rnd.integers(0, 14))) for _ in range(5)]
        ids = np.array([x for p, t in enumerate(pages) for x in [*t, -1 - p]])
        own = np.array([p for p, t in enumerate(pages) for _ in range(len(t) + 1)])
        seen = {}
        for p, t in enumerate(pages):
            for i in range(len(t) - 2):
                seen.setdefault(tuple(t[i : i + 3]), set()).add(p)
        want = []
        for t in pages:
            hit = {i + j for i in range(len(t) - 2) if len(seen[tuple(t[i : i + 3])]) > 1 for j in range(3)}
            want += [i in hit for i in range(len(t))] + [False]
        assert html.repeated_runs(ids, own, 3, 2).tolist() == want


def test_urls(spark):
    given = {
        "http://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://m.example.com/en/1?x": ("m.example.com", "/en/1", "example.com/en/", "block"),
        "https://example.com/EN/1": ("example.com", "/EN/1", "com/", "allow"),
        "x://a.net/es/2#t": ("a.net", "/es/2", "net/es/", "block"),
        "x://a.net/fr": ("a.net", "/fr", None, "allow"),
        "x://xnet/fr/": ("xnet", "/fr/", None, "allow"),
        "http://a.com": ("a.com", "", None, "allow"),
        "no url": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate(given)] + [(0, "http://WWW.Example.com/en/1")]
    got = by_id(urls.judge(spark.createDataFrame(rows, "page_id int, url string")), "id", "host", "path", "rule", "verdict")
    assert got == sorted([(i, *given[u]) for i, u in rows], key=str)
    assert urls.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_url_templates(spark):
    """Unlabelled urls follow their template: merged by likeness, blocked by purity."""
    rows = [("h.net", f"/es/{i}", True) for i in range(30)] + [("h.net", f"/fr/{i}/x", True) for i in range(30)]
    rows += [("h.net", "/ES/99", None), ("h.net", "/en/5", None)] + [("h.net", f"/{w}/a", i // 8 % 2 == 0) for i, w in enumerate("pqrstuvw" * 9)]
    t = urls.templates(spark.createDataFrame(rows, "host string, path string, bad boolean"))
    got = {r.template: r.rejected for r in t.collect()}
    assert got["es/{n}"] and got["fr/{n}/x"] and not got["en/{n}"] and not got["p/a"]


def test_url_labels(spark):
    """Labels of documents reach urls that no rule names, by the number in the path."""
    pages = [(i, f"http://a.org/bad/{i}.html") for i in range(12)] + [(i, f"http://a.org/good/{i}/?x") for i in range(20, 32)] + [(40, "http://a.org/bad/40"), (41, "http://a.org/bad/none"), (42, f"http://a.org/bad/{'9' * 30}.html")]
    labels = [(i, 1, 1) for i in range(8)] + [(i, 1, 0) for i in range(20, 28)] + [(0, 1, 1), (None, 0, 1)]
    labels = urls.doc_labels(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = dict(by_id(urls.judge(spark.createDataFrame(pages, "page_id int, url string"), labels=labels), "id", "verdict"))
    assert got == {i: "block" if i < 12 or i == 42 else "allow" for i, _ in pages}


@pytest.mark.parametrize("siblings", [40, 60])
def test_url_siblings(spark, siblings):
    """Verdicts do not turn on the number of siblings: unlabelled ones stay at the prior, a bad one among good ones is found."""
    rows = [("a.net", f"/es/{i}", True) for i in range(20)] + [("a.net", f"/{chr(97 + i // 26)}{chr(97 + i % 26)}x/{i}", None) for i in range(siblings)]
    rows += [("b.net", f"/{chr(97 + i // 26)}{chr(97 + i % 26)}x/{k}", i == 0) for i in range(siblings) for k in range(20)]
    t = urls.templates(spark.createDataFrame(rows, "host string, path string, bad boolean"))
    assert {(r.host, r.template) for r in t.filter("rejected").collect()} == {("a.net", "es/{n}"), ("b.net", "aax/{n}")}


def test_url_depths(spark):
    """Variable words merge at any depth, though each has one label; a url that none names inherits what its branch shows."""
    word = lambda i: f"{chr(97 + i // 26)}{chr(97 + i % 26)}x"
    rows = [("a.org", f"/shop/{word(i)}/item", True) for i in range(20)] + [("a.org", f"/news/{word(i)}/item", False) for i in range(20)]
    rows += [("b.org", f"/a/{word(i)}/b/{word(i * 7 % 40)}/c/{word(i // 2)}/{i}", i % 10 > 0) for i in range(40)] + [("b.org", "/a/other/b", None)]
    t = urls.templates(spark.createDataFrame(rows, "host string, path string, bad boolean"))
    got = {(r.host, r.template): r.rejected for r in t.collect()}
    assert all(got["a.org", f"shop/{word(i)}/item"] and not got["a.org", f"news/{word(i)}/item"] for i in range(20)) and got["b.org", "a/other/b"]  # nine of ten labels below /a/ are bad


@pytest.mark.parametrize("shard", [8, 400])
def test_html_left_over(spark, shard):
    """Blocks outside an article are judged too: what the host's pages share goes, unique runs stay."""
    page = lambda i: f"<div>Home About Contact our friends and partners Login</div><article><p>body {i}</p></article><div><p>{' '.join(f'u{i}x{k}' for k in range(9))}</p></div>"
    rows = [(i, f"http://h.x/{i}", page(i)) for i in range(24)] + [(0, "http://h.x/0", page(0))]
    got = html.extract(spark.createDataFrame(rows, "page_id int, url string, html string"), shard_pages=shard).collect()
    want = {i: f"body {i}\n\n" + " ".join(f"u{i}x{k}" for k in range(9)) for i in range(24)}
    assert len(got) == 25 and all(r.text == want[r.id] for r in got)


@pytest.mark.parametrize("shard", [8, 400])
def test_html_rare_section(spark, shard):
    """A section on few pages of a large host goes, in any dealing; equal rows are one page, and runs of other hosts do not count."""
    section = "<div>these words of the small section stand on a few pages</div>"
    page = lambda i: f"<div><p>{' '.join(f'u{i}x{k}' for k in range(9))}</p></div>"
    rows = [(i, "http://h.x/", page(i) + (section if i < 5 else "")) for i in range(100)]
    rows += [(200 + i, f"http://{h}.x/", page(200 + i) + section) for i, h in enumerate("kkmm")] + [(200, "http://k.x/", page(200) + section)]
    got = html.extract(spark.createDataFrame(rows, "page_id int, url string, html string"), shard_pages=shard).collect()
    assert len(got) == len(rows) and all(("section" in r.text) == (r.id >= 200) and f"u{r.id}x8" in r.text for r in got)


def test_quality_large_host(spark):
    """A line in 20 documents goes on a host of any size, also where they are copies; rows that repeat are one document."""
    rnd = random.Random(13)
    body = lambda: " ".join(str(rnd.random()) for _ in range(60))
    docs = [(i, ("the notice of a small section\n" if i < 20 else "") + body(), "h") for i in range(400)]
    copy = "\n".join(f"line {chr(97 + k)} of a document that is copied" for k in range(9))
    docs += [(1000 + i, copy, "c") for i in range(20)] + [(2000, copy, "d")] * 20
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.id: (r.n_words, r.n_left) for r in quality.judge(df, max_repeat=100).collect()}
    assert all(got[i] == ((66, 60) if i < 20 else (60, 60)) for i in range(400))
    assert all(got[1000 + i] == (72, 0) for i in range(20)) and got[2000] == (72, 72)


def test_url_inheritance(spark):
    """Templates without labels take the purity to expect at the deepest node that they reach, by wildcards too."""
    word = lambda i: f"{chr(97 + i // 26)}{chr(97 + i % 26)}x"
    rows = [("a.org", f"/shop/{word(i)}/item", True) for i in range(20)] + [("a.org", f"/news/{word(i)}/item", False) for i in range(20)]
    rows += [("a.org", p, None) for p in ("/shop/zzz/item", "/shop/zzz/other/deep", "/shop/zzz/item/more", "/news/zzz/item", "/else", "")]
    rows += [("c.org", f"/{word(k)}/x/{'d/' * k}{i}", True) for k in range(8) for i in range(8)] + [("c.org", "/y", None), ("d.org", "/x/1", None)]
    got = {(r.host, r.template): (r.merged, r.purity, r.rejected) for r in urls.templates(spark.createDataFrame(rows, "host string, path string, bad boolean")).collect()}
    below = lambda above, *shares: (sum(shares) + 4 * above) / (len(shares) + 4)
    host = below(0.2, 1, 0)
    shop = below(host, 1)
    some = below(shop, 1)
    want = {"shop/zzz/item": ("shop/?/item", (20 + 4 * some) / 24), "shop/zzz/other/deep": ("shop/?", some), "shop/zzz/item/more": ("shop/?/item", below(some, 1)), "else": ("", host), "": ("", host)}
    assert all(got["a.org", t][0] == m and abs(got["a.org", t][1] - p) < 1e-9 for t, (m, p) in want.items())
    assert got["a.org", "shop/zzz/item"][2] and not got["a.org", "news/zzz/item"][2] and got["a.org", "shop/aax/item"] == got["a.org", "shop/zzz/item"]
    assert got["c.org", "y"][2] and got["d.org", "x/{n}"] == ("", 0.2, False)


def test_url_edges(spark):
    """Very long urls and paths, and extra columns with the operator's own names."""
    rows = [(1, "http://h.org/" + "a/" * 300 + "1", "x"), (2, "http://h.org/" + "b" * 200_000, "y"), (3, None, None), (3, None, None)]
    got = urls.judge(spark.createDataFrame(rows, "page_id int, url string, host string").withColumnsRenamed({"host": "template"}))
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 3] and {r.verdict for r in got.collect()} == {"allow"}


@pytest.mark.parametrize("tag", ["div", "section class=x"])
def test_html_without_article(spark, sf_dir, tag):
    """Pages whose article is a plain box give the same text: the host's runs and the words of boxes find it."""
    from pyspark.sql import functions as F

    pages = common.table(spark, sf_dir.replace("sf0.001", "sf0.01"), "pages")
    want = {r.id: r.text for r in html.extract(pages).collect()}
    plain = F.regexp_replace(F.regexp_replace("html", "<article>", f"<{tag}>"), "</article>", f"</{tag.split()[0]}>")
    got = {r.id: r.text for r in html.extract(pages.withColumn("html", plain)).collect()}
    assert got == want


@pytest.mark.parametrize("shard", [4, 400])
def test_html_article_runs(spark, shard):
    """Blocks that stand in most distinct articles of a host go, in any dealing; shared passages, copies and blocks of other hosts stay."""
    notice, passage, half = "Sign up for our letter and never miss a story", "a passage that a third of these articles quote", "this line stands in every second one of them"
    body = lambda i: [" ".join(f"u{i}x{k}" for k in range(20)), *[passage] * (i % 3 == 0), f"{notice} on {i}", "short block"]
    page = lambda blocks: f"<nav>menu</nav><article>{''.join(f'<p>{b}</p>' for b in blocks)}</article>"
    texts = {i: ("h", [*body(i), *[notice] * (i % 10 > 0)], body(i)) for i in range(30)}
    texts |= {100 + i: ("h", [notice, "short"], [notice, "short"]) for i in range(2)}  # nothing else: whole
    texts |= {200 + i: ("k", [*body(i), *[half] * (i % 2)], [*body(i), *[half] * (i % 2)]) for i in range(30)}  # in half of the articles
    texts |= {300 + i: ("c", [*body(0), notice], [*body(0), notice]) for i in range(30)}  # one article
    texts |= {400 + i: ("d", [*body(i), notice], [*body(i), notice]) for i in range(2)}
    rows = [(i, f"http://{h}.x/{i}", page(blocks)) for i, (h, blocks, _) in texts.items()]
    df = spark.createDataFrame([*rows, rows[1]], "page_id int, url string, html string")
    got = html.extract(df, shard_pages=shard).collect()
    assert len(got) == len(rows) + 1 and all(r.text == "\n\n".join(texts[r.id][2]) for r in got)


def test_html_common_runs():
    """Every run in most distinct articles of a host is found in a shard, where an array holds one article too; equal articles count once."""
    import pyarrow as pa

    rnd = random.Random(14)
    for _ in range(60):
        own = [[" ".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 4))] for _ in range(rnd.randrange(1, 9))]
        distinct = [list(x) for x in {tuple(x) for x in own}]
        runs = [{" ".join(w[i : i + 3]) for b in blocks for w in [b.split()] for i in range(len(w) - 2)} for blocks in distinct]
        want = {r for x in runs for r in x if 2 * sum(r in y for y in runs) > len(runs) and sum(r in y for y in runs) >= 3}
        coded = lambda rows: [r for b in html._codes(3)([pa.RecordBatch.from_pydict({"host": ["h"] * len(rows), "content": [0] * len(rows), "blocks": [[None, *r, None] for r in rows]})]) for r in b.column("codes").to_pylist()]
        named = lambda rs: {int(html.run_hashes(np.frombuffer(c, np.uint16), np.ones(1, np.int64), 3)[0]) for c in coded([[r] for r in rs])}
        for shards, size in ((1, 1 << 20), (1, -1), (3, 1 << 20)):
            rows = sorted((i % shards, i, codes) for i, codes in enumerate(coded(distinct)) for _ in range(1 + i % 2))
            batch = pa.RecordBatch.from_pydict({"host": ["h"] * len(rows), "shard": [r[0] for r in rows], "shards": [shards] * len(rows), "content": [r[1] for r in rows], "codes": [r[2] for r in rows]})
            with pytest.MonkeyPatch.context() as m:
                m.setattr(html, "ARRAY_BYTES", size)
                got = {r for b in html._common_runs(3, 3)([batch.slice(0, 2), batch.slice(2)]) for r in b.column("run").to_pylist()}
            assert got >= (known := named(want) if want else set()) and (got == known or (shards, size) != (1, 1 << 20))


def test_html_structure():
    """Headings of an article's header, teasers, names in doubt, and main boxes."""
    texts = lambda page: [t for _, t in html.blocks(page)[0]]
    assert texts("<article><header><h1>Title</h1><p>by us</p></header><p>one two</p></article><header><h1>Site</h1></header>") == ["Title", "one two"]
    assert texts(f"<article><p>{'w ' * 50}</p></article><div><article><p>teaser</p></article></div>") == [" ".join("w" * 50)]
    assert texts("<article><p>one two</p></article><article><p>three</p></article>") == ["one two", "three"]
    assert texts("<div class='content has-banner'><p>one two three</p></div><div class=banner>four</div><p>five</p>") == ["one two three", "five"]
    own, _, _ = html.parse("<body><div><div><p>one two three four five six</p><p>seven</p></div><div>eight</div></div></body>")
    assert [k for k, _ in own] == [1, 1, 0]


def test_html_long_pages():
    """Reading is linear: tags that close or open nothing else, and very long text."""
    import time

    for make in (lambda n: "<b>" * n + "</i>" * n, lambda n: "<div>" * n + "</p>" * n, lambda n: "<p><td>" + "<b>" * n + "<h2>x</h2>" * n, lambda n: "<li>" * n, lambda n: "<div><p>x" * n, lambda n: "word " * n, lambda n: "<" * n, lambda n: "<!--" * n, lambda n: "<a '\"" * n):
        took = []
        for n in (4000, 32000):
            start = time.process_time()
            html.parse(make(n))
            took.append(time.process_time() - start)
        assert took[1] < 40 * took[0] + 0.5, make(3)


CLASHING = "_id _key _row row_key removed own_key mark_id mark_key ids n_tokens text_a key rep leader line n c0 c1 kept".split()


def test_clashing_columns(spark):
    """Columns with the operators' own names come back as they were."""
    from pyspark.sql import functions as F

    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words + "\nsame line", "s"), (2, words + " x\nsame line", "s"), (3, "bench words here", "s"), (3, "bench words here", "s"), (None, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0))).alias(c) for c in CLASHING])
    items = spark.createDataFrame([(1, "bench words here")], "item_id long, text string")
    want = {
        "quality": [(1, rows[0][1]), (2, rows[1][1])],
        "lines": [(1, rows[0][1]), (2, words + " x"), (3, rows[2][1]), (3, rows[2][1]), (None, None)],
        "near": [(1, rows[0][1]), (3, rows[2][1]), (None, None)],
        "decontaminate": [(1, rows[0][1]), (2, rows[1][1]), (None, None)],
    }
    got = {"quality": quality.clean(docs), "lines": line_dedup.clean(docs, min_bytes=600), "near": near_dup.clean(docs), "decontaminate": decontaminate.clean(docs, items)}
    for name, out in got.items():
        assert out.columns == docs.columns
        found = out.collect()
        assert sorted([(r.doc_id, r.text) for r in found], key=str) == sorted(want[name], key=str), name
        assert all(r[c] == f"{c}{r.doc_id or 0}" for r in found for c in CLASHING)
    encoded = bpe.encode(docs)
    assert all(r.ids_given == f"ids{r.doc_id or 0}" and len(r.ids) == r.n_tokens and r.n_tokens_given == f"n_tokens{r.doc_id or 0}" for r in encoded.collect())
    assert {"n_tokens", "n_tokens_given", "n_words"} <= set(token_counts.count(docs).columns)


def test_bpe_long_pieces():
    """The heap of long pieces and the matrices give the same ids, on both sides of the limit."""
    rnd = random.Random(17)
    pieces = ["".join(rnd.choice("abé ☃中thein") for _ in range(rnd.choice([3, 20, 90]))).encode() for _ in range(200)]
    ids = [bpe.Codec(*map(str, bpe.default_vocabulary()), long=long).pieces(pieces) for long in (1, 40, 10**6)]
    for own, counts in ids[1:]:
        assert own.tolist() == ids[0][0].tolist() and counts.tolist() == ids[0][1].tolist()


def test_language_decisions():
    """Families by the largest margin, then votes of pairs, against plain loops over dense vectors."""
    rnd = np.random.default_rng(18)
    langs = [rnd.choice(["de", "nl", "es", "fr", "it", "zh"]) for _ in range(120)]
    model = langid.fit(langs, rnd.integers(0, 9, (120, langid.DIMS)).astype(np.float32))
    docs = [rnd.integers(0, langid.DIMS, n) for n in (1, 5, 40, 300, 40, 7)]
    got, scores = langid.decide(model, np.concatenate(docs), np.cumsum([0, *map(len, docs)]))
    for codes, lang, score in zip(docs, got, scores, strict=True):
        x = np.bincount(codes, minlength=langid.DIMS) / len(codes)
        value = lambda m: float(x @ m[0] + m[1])
        squash = lambda v: 1 / (1 + np.exp(-2 * v))
        family = max(model["family"], key=lambda f: value(model["family"][f]))
        want, own = squash(value(model["family"][family])), model["families"][family]
        votes = {a: np.mean([squash(value(model["pairs"][a, b])) if (a, b) in model["pairs"] else 1 - squash(value(model["pairs"][b, a])) for b in own if b != a]) for a in own} if len(own) > 1 else {own[0]: 1.0}
        assert lang == max(votes, key=votes.get) and abs(score - want * max(votes.values())) < 1e-9
