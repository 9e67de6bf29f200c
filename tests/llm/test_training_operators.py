"""The training-data operators against brute force, the libraries they stand for, and awkward tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandframe.llm import ann, exact_dedup, html_extraction, mixing, packing, simhash, substring_dedup, token_counts, toxicity, warc
from strandframe.session import table

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row long"
BLANK = str.maketrans("", "", " \t\n\r\x0b\x0c")


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents with nulls, empty and long texts, copies, near copies, repeated rows and clashing column names."""
    rng = random.Random(4)
    rows = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()][:60]
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "it's", "1234"]) + str(rng.randrange(300)) for _ in range(400))
    texts = [None, "", " \t\n", "one", base, base + " ", base.replace("alpha1 ", "alpha2 "), base[:1200] + " other end", "é" * 700, "a" * 2000, "x <|endoftext|> y", "日本語 ١٢ ½ \U0001f600 " * 40, base * 20]
    rows += [(1000 + i, t, "en", s, 0) for i, (t, s) in enumerate(zip(texts, ["s1", "s2", None, "s1", "é", "z", "s1", "s2", None, "s1", "s2", "s3", "s3"]))]
    rows += [rows[0], rows[0], (None, base, None, None, None), (None, None, None, None, None), (1004, "same id, other text", "en", "s1", 3)]
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


TEXTS = st.text(st.sampled_from("ab'srevltmd 1!.\n\t  éÉ日١½\U0001f600̀\x1c\x85<|endoftext|>"), max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_op1_machine_equals_the_tokenizer(texts):
    want = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    spec = token_counts.load_spec(VOCABULARY)
    assert token_counts.counter(spec)(texts).tolist() == [len(w) for w in want]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encoder(spec)(texts)] == want


def test_op8_word_table_is_bounded():
    spec, rng = token_counts.load_spec(VOCABULARY), random.Random(8)
    encode = packing.Encoder(spec, most=64)
    for _ in range(12):
        texts = [" ".join(str(rng.randrange(90)) + rng.choice(["a", "'ll", "é", "x" * 70, "<|endoftext|>"]) for _ in range(60)) for _ in range(3)] + [""]
        want = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want
        assert encode.known.words <= 64


_tokenizer = []


def tokenizer():
    if not _tokenizer:
        _tokenizer.append(Tokenizer.from_file(VOCABULARY))
    return _tokenizer[0]


@pytest.mark.parametrize("pair", ["eq", "ab", "th"])
def test_op1_op8_words_that_polynomial_hashes_confuse(pair):
    texts = ["".join(pair[i.bit_count() + flip & 1] for i in range(1 << bits)) for bits in range(9, 13) for flip in (0, 1)]
    want = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    spec = token_counts.load_spec(VOCABULARY)
    assert token_counts.counter(spec)(texts).tolist() == [len(w) for w in want]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encoder(spec)(texts)] == want


def test_op1_counts(docs, plain):
    want = Counter((i, len(t.encode()), n := len(tokenizer().encode(t, add_special_tokens=False).ids), n > 512) for i, t, _ in plain)
    assert counted(token_counts.token_counts(docs, VOCABULARY), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(docs.limit(0), VOCABULARY).count() == 0


def test_op2_targets_and_limits(docs, plain):
    got = mixing.mix_report(docs).collect()
    size = lambda t: len(t.encode().split())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in plain)
    assert all(r.taken <= 2 * r["size"] for r in got)
    total = Counter()
    for _, t, s in plain:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    aims = mixing.targets([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(total.values()), 2)
    assert sum(aims) == pytest.approx(1.5 * sum(total.values())) and all(a <= 2 * total[s] + 1e-9 for a, s in zip(aims, names))
    assert sum(r.taken for r in got) == pytest.approx(sum(aims), abs=len(names))
    again = mixing.mix_report(docs.repartition(5)).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_op2_each_source_takes_its_target(docs, plain):
    sizes, weight = {}, {}
    for _, t, s in plain:
        sizes[s] = sizes.get(s, 0) + len(t.encode().split())
    for place, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weight[s] = [5, 2, 1][place % 3]
    aims, left = {}, 1.5 * sum(sizes.values())  # the rule in words: stop at twice the size, share the excess again
    while True:
        open_ = [s for s in sizes if s not in aims]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            aims |= share
            break
        for s in over:
            aims[s] = 2.0 * sizes[s]
            left -= aims[s]
    size_of, taken = Counter(), Counter()
    sources = {}
    for i, t, s in plain:
        sources.setdefault((i, len(t.encode().split())), set()).add(s)
    for r in mixing.mix_report(docs).collect():
        (source,) = [s for s in sources[r.doc_id, r["size"]] if sizes[s] == r.source_size]
        assert r.target == pytest.approx(aims[source])
        taken[source] += r.taken
        size_of[source] = r.source_size
    assert size_of == sizes
    for s, aim in aims.items():
        assert abs(taken[s] - aim) <= 1


def test_op2_same_text_in_two_sources(spark):
    df = spark.createDataFrame([(1, "a b c d e f", s) for s in ("x", "y", None)] + [(2, "g " * 600, "x")], "doc_id long, text string, source string")
    got = mixing.mix_report(df).collect()
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert sum(len(r.text.split()) for r in mixing.mix_documents(df).collect()) == sum(r.taken for r in got)


def test_stages_with_columns_of_any_name(spark):
    names = "d h c epoch runs s i _id _y _hash _copy _source k1 k2 row _n words size".split()
    df = spark.createDataFrame([(i, f"word{i} some more words {i} of text number {i}", "s", *names) for i in range(12)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(12)], "doc_id long, toxic int")
    for out in (toxicity.drop_toxic(df, marks), exact_dedup.keep_distinct(df), simhash.keep_one(df), mixing.mix_documents(df)):
        assert out.columns == df.columns
        assert all(r[n] == n for r in out.collect() for n in names)
    assert toxicity.toxicity_scores(df, marks).count() == packing.pack_documents(df, VOCABULARY).where("start = 0").count() == 12


def test_op2_targets_reshare():
    assert mixing.targets([10, 1000, 1000], [5, 2, 1], 900, 2) == pytest.approx([20, 880 * 2 / 3, 880 / 3])
    assert mixing.targets([0, 0], [5, 2], 0, 2) == [0, 0]


@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_op2_permutation(n, key):
    got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
    assert sorted(got.tolist()) == list(range(n))


def test_op2_documents_hold_the_words_taken(docs):
    taken = sum(r.taken for r in mixing.mix_report(docs).collect())
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").encode().split()) for r in mixed.collect()) == taken


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_op3_groups(docs, plain, share):
    groups = {}
    for i, t, _ in plain:
        groups.setdefault(hashlib.sha256(t.translate(BLANK).encode()).hexdigest(), []).append((-len(t), i is None, i or 0))
    got = exact_dedup.exact_dedup(docs, share).collect()
    want = Counter((i, h := hashlib.sha256(t.translate(BLANK).encode()).hexdigest(), len(groups[h])) for i, t, _ in plain)
    assert Counter((r.doc_id, r.text_sha256, r.group_size) for r in got) == want
    for r in got:
        best = min(groups[r.text_sha256])
        assert r.keep_id == (None if best[1] else best[2])
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(groups.keys())
    assert exact_dedup.keep_distinct(docs).count() == len(groups)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


@given(st.integers(0, 400))
def test_op3_hash_is_minimal_and_perfect(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(n)), np.uint64).reshape(-1, 4)
    assert sorted(exact_dedup.PerfectHash(keys).slots(keys).tolist()) == list(range(n))


def test_op4_pages(spark):
    page = "<nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>A &amp; B</h1><script>var t='</p>'</script><p>one\n two <b>three</b><br>four" + " word" * 30 + "<p>caf&eacute; &#8364;" + " word" * 30 + "</article><!-- x --><footer>foot</footer><div class='comments'><p>" + "talk " * 40 + "</div>"
    df = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (None, "v", "", "t"), (4, "w", "<p>cut <a hre", "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extraction.extract(df).collect()}
    assert got[1].text == "A & B\n\none two three four" + " word" * 30 + "\n\ncafé €" + " word" * 30
    assert (got[2].text, got[2].n_chars, got[None].text) == ("", 0, "")
    assert got[1].n_chars == len(got[1].text)
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_op4_tree_fits_its_table():
    x, y = html_extraction.labelled()
    assert (html_extraction.tree()(x) == (y > 0.5)).mean() > 0.95


def test_op4_articles_of_the_pages(spark):
    import html
    import re

    for r in table(spark, DATA, "pages").where("html is not null").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        want = re.sub(r"\s", "", html.unescape(re.sub(r"<!--.*?-->|<[^>]*>", " ", inner[1])))
        assert re.sub(r"\s", "", html_extraction.main_text(r.html)) == want


@pytest.mark.parametrize("name", ["social-science", "share-price-report", "notice-board", "post has-comments", "reply-to-all", "content-sidebar-left"])
def test_op4_classes_that_merely_hold_a_listed_word(name):
    body = [" ".join(["sentence", "number", str(i), *["of", "the", "report"] * 8]) + "." for i in range(4)]
    page = f"<body><nav><a href='/'>home</a></nav><div class='{name}'><h1>Title of it</h1>" + "".join(f"<p>{t}</p>" for t in body) + "</div><div class='site-footer'><p>" + "foot " * 30 + "</p></div>"
    assert html_extraction.main_text(page) == "\n\n".join(["Title of it", *body])


def test_op4_marked_classes_and_buttons():
    text = "word " * 30
    for name in ("sidebar", "cookie-notice", "site-footer", "comment-list", "main-nav", "newsletter-signup"):
        page = f"<body><article><p>{text}</p></article><div class='{name}'><p>{text}other</p></div>"
        assert html_extraction.main_text(page) == text.strip()
    assert html_extraction.main_text(f"<body><article><p>{text}<button type=button>Copy</button> {text}</p></article>") == (text * 2).strip()


def test_op4_stray_ends_and_deep_pages_are_linear():
    import time

    def seconds(n):
        page = "<div>" * n + "</section></ul>" * n + "<p>end of it</p>"
        start = time.process_time()
        html_extraction.main_text(page)
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 20 * max(seconds(4_000), 0.02)


def test_op4_pages_without_telling_names():
    rng = random.Random(44)
    say = lambda n: " ".join(rng.choice("harbour light window quiet river seven morning walked stone paper under bright carry winter".split()) for _ in range(n)).capitalize() + "."
    right = total = 0
    for _ in range(40):
        menu = "".join(f"<li><a href='/{i}'>{say(rng.randrange(1, 4))}</a></li>" for i in range(rng.randrange(3, 8)))
        body = [say(rng.randrange(25, 90)) for _ in range(rng.randrange(3, 9))]
        tail = "".join(f"<div class='x{i}'><a href='/{i}'>{say(rng.randrange(2, 7))}</a></div>" for i in range(rng.randrange(2, 5)))
        page = f"<body><div class='a1'><ul>{menu}</ul></div><div class='b2'>" + "".join(f"<p>{t}</p>" for t in body) + f"</div><div class='c3'>{tail}</div></body>"
        found = html_extraction.blocks(page)
        assert not any(b[2] or b[3] for b in found)  # neither an article nor an aside is marked
        keep = html_extraction.tree()(html_extraction.features(found))
        right += sum(bool(k) == (b[0] in body) for b, k in zip(found, keep))
        total += len(found)
    assert right / total > 0.95


def test_op5_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16))
    x[700:760] = x[700]
    data = [(i, v.tolist(), 0.0) for i, v in enumerate(x)] + [(5000, None, 0.0), (5020, [0.0] * 16, 0.0), (5040, [float("nan")] * 16, 0.0), (None, x[0].tolist(), 0.0), (5060, [None] + [1.0] * 15, 0.0), (5080, [1.0, 2.0], 0.0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score double")
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        assert len(got[q]) == 20 and all(abs(score - s[i]) < 1e-9 for i, score in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in got[q]} & set(want))
    assert hits / (20 * 75) >= 0.9 and set(got) == set(range(0, 1500, 20))
    assert ann.search(df.limit(0)).count() == 0


@pytest.mark.parametrize(("dimension", "spread", "share"), [(64, None, 0.65), (64, 0.0, 0.8), (64, 1.0, 0.4), (128, None, 0.9)])
def test_op5_recall_at_the_size_of_a_shard(dimension, spread, share):
    """Unit vectors (no spread), plain normal ones, and lengths spread log-normally."""
    rng, n = np.random.default_rng(dimension), ann.SHARD - 1
    x = rng.standard_normal((n, dimension))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if spread is None else x * np.exp(spread * rng.standard_normal(n))[:, None]
    ids = np.arange(n)
    asked = x[::40], ids[::40]
    got = ann.nearest(x, ids, *asked, 20)
    hits = 0
    for q, i in zip(*asked):
        s = x @ q
        s[i] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & set(got[1][got[0] == i].tolist()))
    assert got[0].size == 20 * len(asked[1]) and hits / got[0].size >= 0.95
    shard = ann.Shard(x, asked[0][:64], 20)
    shard.candidates(asked[0][64:192], 20)
    assert shard.scored / (128 * n) < share


def test_op5_one_long_vector_and_small_shards():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32))
    x[17] *= 1000
    ids = np.arange(3000)
    got = ann.nearest(x, ids, x[::30], ids[::30], 20)
    exact = np.argsort(-(x[::30] @ x.T), axis=1)
    hits = [len(set(got[1][got[0] == q].tolist()) & set(exact[i][exact[i] != q][:20].tolist())) for i, q in enumerate(ids[::30])]
    assert sum(hits) / (20 * len(hits)) >= 0.95 and all(17 in got[1][got[0] == q] for q in ids[30::30] if 17 in exact[q // 30][:20])
    assert [len(b) for b in ann.bands(np.zeros(0))] == [] and ann.nearest(x[:3], ids[:3], x[:1], ids[:1], 20)[1].size == 2


def plain_ftrl(rows, labels):
    """Follow the regularised leader, coordinate by coordinate."""
    z, n, weights = {}, {}, {}
    for _ in range(toxicity.EPOCHS):
        for row, y in zip(rows, labels):
            keys = ["bias", *row.tolist()]
            for k in keys:
                l1 = 0 if k == "bias" else toxicity.L1
                zk, nk = z.get(k, 0.0), n.get(k, 0.0)
                weights[k] = 0.0 if abs(zk) <= l1 else (l1 * (1 if zk > 0 else -1) - zk) / ((toxicity.BETA + nk**0.5) / toxicity.ALPHA)
            p = 1 / (1 + np.exp(-sum(weights[k] for k in keys)))
            for k in keys:
                nk = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + (p - y) - ((nk + (p - y) ** 2) ** 0.5 - nk**0.5) / toxicity.ALPHA * weights[k]
                n[k] = nk + (p - y) ** 2
    return {k: (np.sign(zk) * toxicity.L1 - zk) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA) for k, zk in z.items() if k != "bias" and abs(zk) > toxicity.L1}


def test_op6_weights_are_those_of_plain_ftrl():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    labels = [int("j" in t) for t in texts]
    rows = toxicity.feature_sets(texts)
    at, w, _ = toxicity.fit(rows, labels)
    want = plain_ftrl(rows, labels)
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx(want)


def test_op6_an_id_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, "one text")] * 50 + [(1, "another text")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    once = spark.createDataFrame([(1, "another text")], "doc_id long, text string")
    assert toxicity.train(docs, marks)[2] == toxicity.train(once, marks)[2]


def test_op6_learns_planted_words(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    data, labels = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["scum", "trash", "moron"])
        data.append((i, " ".join(text), "en", 9))
        labels.append((i, 1, int(toxic), "t"))
    data += [(None, "scum", None, 1), (5000, None, None, 1), (5001, "", None, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, toxic int")
    marks = spark.createDataFrame(labels + [(None, 1, 1, "x"), (7, 0, None, "y"), (9999, 0, 1, "z")], "doc_id long, quality int, toxic int, text string")
    got = toxicity.toxicity_scores(docs, marks).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: t for i, _, t, _ in labels}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)
    assert toxicity.toxicity_scores(docs.limit(0), marks.limit(0)).count() == 0


def fingerprint(text):
    words = text.encode().translate(simhash.LOWER).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_op7_components(docs, plain):
    prints = [(i, fingerprint(t)) for i, t, _ in plain]
    parent = list(range(len(prints)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(prints):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    want = Counter((i, f"{f:016x}", least.get(root(a))) for a, (i, f) in enumerate(prints))
    assert counted(simhash.simhash_groups(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({root(a) for a in range(len(prints))})
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_op7_dense_group_of_prints(spark):
    rng = random.Random(7)
    prints = {0} | {sum(1 << rng.randrange(64) for _ in range(2)) for _ in range(1500)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    from strandframe.operators.components import connected_components

    assert {r.component for r in connected_components(simhash.links(df)).collect()} == {min(p - (1 << 64) if p >> 63 else p for p in prints)}


def test_op8_pieces(docs, plain):
    ids = {}
    for i, t, _ in plain:
        tokens = np.array(tokenizer().encode(t, add_special_tokens=False).ids + [1], dtype="<u4")
        ids.setdefault(i, []).append(tokens)
    got = packing.pack_documents(docs, VOCABULARY).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert any(len(t) == r.doc_tokens and zlib.crc32(t[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for t in ids[r.doc_id])
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert Counter({i: sum(map(len, t)) for i, t in ids.items()}) == sum((Counter({r.doc_id: r.length}) for r in got), Counter())
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0


@given(st.lists(st.integers(1, 300), max_size=60))
def test_op8_pack_is_whole_and_unpadded(lengths):
    sequences = packing.pack(lengths, 64)
    seen = Counter()
    for pieces in sequences:
        n = sum(p[2] for p in pieces)
        assert n == 64 or n < 64 and n & (n - 1) == 0
        for d, at, size in pieces:
            seen.update((d, at + i) for i in range(size))
    assert seen == Counter((d, i) for d, n in enumerate(lengths) for i in range(n))


@given(st.lists(st.integers(1, 50), max_size=60))
def test_op8_first_fit_decreasing(sizes):
    bins, want = packing.first_fit_decreasing(sizes, 50), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        home = next((b for b in want if sum(sizes[j] for j in b) + sizes[i] <= 50), None)
        if home is None:
            want.append(home := [])
        home.append(i)
    assert bins == want


def test_op9_round_trip(spark, tmp_path):
    big, odd = "<p>" + "é" * 700, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 40
    data = [(1, "http://a/x y\r\nX: 1", big, "t"), (2, None, big, "t"), (3, "u", "short", "t"), (4, "u", "short", "t"), (5, "u", None, "t"), (None, "n", big, "t"), (7, "u", odd, "t"), (8, "u", odd, "t"), (2, None, big, "t"), (9, "u", "", "t")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, record_type string")
    got = counted(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = Counter()
    spent = set()
    for i, _, h, _ in data:
        n, last = len((h or "").encode()), {big: 2, odd: 8}.get(h)
        first = last is None or i == last and i not in spent
        spent.add(i)
        want[(i, n, sha(h), "response" if first else "revisit", None if first else last)] += 1
    assert got == want
    path = f"file://{tmp_path}/w"
    warc.write_archive(df.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")), path)
    nested = warc.captures(warc.read_records(spark, path)).collect()
    assert len(nested) == len(data) and all(r.request and r.metadata for r in nested)
    assert Counter(bytes(r.response.payload) for r in nested if r.response.type == "response")[big.encode()] == 1
    assert warc.round_trip(df.limit(0)).count() == 0


@given(st.lists(st.lists(st.sampled_from([b"\r\n", b"\r\n\r\n", b"x", b"\r", b"\n", b"WARC/1.1\r\n"]), max_size=6).map(b"".join), min_size=1, max_size=5))
def test_op9_pieces_become_records(blocks):
    data = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    pieces = data.removesuffix(b"\r\n\r\n").split(b"\r\n\r\n")
    parser = warc.Parser()
    assert [b for p in pieces for _, b in parser.feed(p)] + [b for _, b in parser.end()] == blocks


def test_op9_one_member_a_record_and_cut_off(spark, tmp_path):
    import gzip

    record = lambda body: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n%s\r\n\r\n" % (len(body) + 19, body)
    bodies = [b"\xff\x00\r\n\r\n" * 9, b"", b"y" * 300_000]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(b)) for b in bodies))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(b"z" * 50)[:-30]))
    got = [bytes(r.payload) for r in warc.read_records(spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == sorted([*bodies, b"z" * 24])


def brute_repeats(texts, n=400):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for t in texts:
        edge = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                edge[i] += 1
                edge[i + n] -= 1
        yield np.cumsum(edge)[:-1] > 0


def test_op10_against_brute_force(spark, docs, plain):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, short, base = word(450), word(330), word(1500)
    more = [word(300) + common + word(rng.randrange(200)) for _ in range(40)] + [word(300) + short + word(200) for _ in range(40)] + ["a" * 399, "a" * 400, "ab" * 600]
    more += [base[:k] + "Z" + base[k + 1 :] for k in rng.sample(range(1500), 30)]
    extra = [(3000 + i, t, "", "", 0, "", 0) for i, t in enumerate(more)]
    df = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    rows = [(i, t.encode()) for i, t, _ in plain] + [(r[0], r[1].encode()) for r in extra]
    want = Counter()
    for (i, t), gone in zip(rows, brute_repeats([t for _, t in rows])):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if len(gone) else t
        want[(i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(gone) else 0, hashlib.sha256(kept).hexdigest())] += 1
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert counted(substring_dedup.remove_repeats(df), *columns) == want
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_op10_large_groups_are_refined(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = word(430)
    texts = [word(310) + common[: rng.randrange(395, 431)] + word(310) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = substring_dedup.keyed(df, "doc_id", "text")
    runs = {r.k1: r.runs for r in substring_dedup.stretches(keyed, group=20).collect()}
    for i, gone in enumerate(brute_repeats([t.encode() for t in texts])):
        got = substring_dedup.covered(len(texts[i]), [r.asDict() for r in runs.get(i, [])])
        assert (got == gone).all()


def test_op10_over_500_contexts_as_it_comes(spark):
    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, base = word(410), word(900)
    texts = [word(305) + common[: rng.randrange(396, 411)] + word(305) for _ in range(560)]
    texts += ["".join("#" if rng.random() < 0.002 else c for c in base) for _ in range(620)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter((i, int(gone.sum())) for i, gone in enumerate(brute_repeats([t.encode() for t in texts])))
    assert counted(substring_dedup.remove_repeats(df), "doc_id", "n_removed") == want


def test_op10_refined_groups_keep_their_partners(spark):
    rng = random.Random(11)
    base = bytes(rng.randrange(97, 123) for _ in range(700)).decode()
    change = lambda text, *at: "".join(c.upper() if i in at else c for i, c in enumerate(text))
    anchor, _ = substring_dedup.anchor_positions(np.frombuffer(base.encode(), np.uint8), np.full(700, 700), 400, 100)
    p = int(anchor[len(anchor) // 2])
    near = [base, change(base, p - 250), change(base, p - 31)]
    groups = [near, [change(base, *rng.sample(range(700), rng.randrange(1, 3))) for _ in range(12)] + near]
    for texts in groups:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        runs = {r.k1: r.runs for r in substring_dedup.stretches(substring_dedup.keyed(df, "doc_id", "text"), group=2).collect()}
        for i, gone in enumerate(brute_repeats([t.encode() for t in texts])):
            got = substring_dedup.covered(len(texts[i]), [r.asDict() for r in runs.get(i, [])])
            assert (got == gone).all()


def test_op10_pieces_of_a_long_text_share_no_anchor(spark):
    rng = np.random.default_rng(12)
    size = substring_dedup.SEGMENT
    clean = rng.integers(97, 123, 2 * size + 5000, np.uint8).tobytes().decode()
    twice = clean[size - 200 : size + 300]
    df = spark.createDataFrame([(1, clean), (2, twice + "#" * 100), (3, clean[::-1]), (3, clean[::-1])], "doc_id long, text string")
    got = counted(substring_dedup.remove_repeats(df), "doc_id", "n_removed", "n_spans")
    assert got == {(1, 500, 1): 1, (2, 500, 1): 1, (3, len(clean), 1): 2}


def test_op6_without_usable_labels_keeps_all(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (None, "other words")], "doc_id long, text string")
    held = next(i for i in range(3, 99) if zlib.crc32(str(i).encode()) % 5 == 0)
    for labels in ([], [(1, None)], [(held, 1)]):
        marks = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert counted(toxicity.drop_toxic(docs, marks), "doc_id", "text") == counted(docs, "doc_id", "text")
        assert {r.score for r in toxicity.toxicity_scores(docs, marks).collect()} == {0.5}


def test_op4_marks_only_what_is_marked():
    body = "<p>Some words of the article.</p>"
    marks = lambda page: [(b[0], b[3]) for b in html_extraction.blocks(page)]
    want = [("Some words of the article.", False)]
    for attributes in ('data-title="hidden gems"', 'data-visibility="hidden"', 'data-id="comments-12"', 'title="an id=comments"', 'class="post has-comments"', 'class="site no-sidebar"'):
        assert marks(f"<div {attributes}>{body}</div>") == want
    assert marks(f'<div class="popup"><main>{body}</main></div>') == want
    assert marks(f'<div class="popup"><article>{body}</article></div>') == want
    assert [m for _, m in marks(f'<article>{body}</article><div id="comments"><article>{body}</article></div>')] == [False, True]
    assert marks(f"<nav><article>{body}</article></nav>") == [(want[0][0], True)]
    for tag in ("p", "li", "td", "h2"):
        assert marks(f'<article><{tag} class="advert">Buy</{tag}>{body}</article>') == [("Buy", True), *want]
    assert marks("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p>") == [("If x=2 holds", False)]
    for attributes in ("hidden", "hidden=''", 'style="display: none"', "aria-hidden=true"):
        assert marks(f"<div {attributes}>{body}</div>") == []
