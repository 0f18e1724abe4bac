import hashlib
import random
import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import byte_bpe, char_classes, exact_dedup, order_minhash, ordinal_quality, pii_surrogates, template_decontam, token_transducer, toxicity_chain, url_trees, warc_index
from textloom.llm.components import components
from textloom.llm.hashed_linear import Rows

WORDS = [f"{a}{b}" for a in "kan lor mir tes vul pon gar".split() for b in "do ra li mo ne tu".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, texts, first=0):
    """Documents with a null id row, further columns with clashing names, in several partitions."""
    rows = [(first + k, t, "d", "digest", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, node string, kept int").repartition(3)


ODD = [None, "", " ", "a", "a", "\t\n", "x" * 30_000, "é中🚀'll don't  \n\n x", "<|endoftext|>"]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- exact dedup -------------------------------------------------------------------------------


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_exact_groups_by_brute_force(spark, digest_bytes):
    rng = random.Random(1)
    base = [prose(rng, 5) for _ in range(20)]
    texts = ODD + [rng.choice(base).replace(" ", rng.choice([" ", "  ", "\n"]), 2) for _ in range(80)]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    got = exact_dedup.exact_groups(docs_of(spark, texts), digest_bytes=digest_bytes or 1).collect()
    assert len(got) == len(texts)
    for r in got:
        same = [k for k, t in enumerate(norm) if t == norm[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (same[0], len(same), r["doc_id"] == same[0])
        if digest_bytes == 32:
            assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()


def test_exact_repeats_nulls_and_columns(spark, empty):
    rows = spark.createDataFrame([(1, "t"), (1, "t"), (None, "t"), (None, "u"), (None, "u")], "doc_id long, text string")
    got = exact_dedup.exact_groups(rows)
    assert got.where("kept").count() == 2 and got.where("group_size = 3").count() == 3
    assert exact_dedup.exact_groups(empty).count() == 0
    carried = exact_dedup.exact_groups(docs_of(spark, ["a", "a", "b"]), carry=True)
    assert carried.columns == ["doc_id", "text", "keep_id", "node", "kept"] and sorted(r["doc_id"] for r in carried.collect()) == [0, 2]


def test_index_levels(spark):
    index = exact_dedup.DigestIndex(spark, fanout=2)
    assert index.compact().isEmpty() and index.rows().isEmpty() and index.probe([b"a"]).isEmpty()
    rows = spark.createDataFrame([(bytearray(b"a"), 3), (bytearray(b"b"), 1)], "digest binary, id long")
    index.flush(rows)
    index.flush(rows.withColumn("id", F.col("id") - 1))
    held = index.merged
    found = lambda: {(bytes(r["digest"]), r["keep_id"], r["n"]) for r in index.probe([b"a", b"b"]).collect()}
    assert index.fresh == [] and index.rows().isEmpty() and found() == {(b"a", 2, 2), (b"b", 0, 2)} and index.merged == held
    index.flush(rows.withColumn("id", F.col("id") + 7))
    assert index.rows().count() == 2 and found() == {(b"a", 2, 3), (b"b", 0, 3)}


def test_exact_groups_over_levels(spark):
    texts = ["a", "b  c", "b c", "a", None, "", "d", "a", "e"] * 3 + ["single"]
    one, many = (sorted(map(tuple, exact_dedup.exact_groups(docs_of(spark, texts), batches=n, fanout=2).collect())) for n in (1, 5))
    assert one == many and len(one) == len(texts)


# --- byte-level BPE and token counts ----------------------------------------------------------------


def random_texts(rng, n):
    alphabet = "abcde eéß中日🚀'  \n\t12 .,!?ththeeaaaa　\xa0\x1c\x85'srvlmdte"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(n)] + ["".join(rng.choice("aeth") for _ in range(3_000))]


def test_encoding_is_that_of_the_library(spark, empty):
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(ranks), special_tokens={})
    texts = ODD + random_texts(random.Random(2), 300)
    got = byte_bpe.encode_texts(docs_of(spark, texts), ranks, P.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids) and r["decoded_ok"]
    assert byte_bpe.encode_texts(empty, ranks, P.PATTERN).count() == 0


def test_compatible_tokens_are_those_that_merges_leave():
    rng = random.Random(23)
    ranks = byte_bpe.parse_ranks(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    bpe = byte_bpe.ByteBPE(ranks, P.PATTERN)
    pairs = [(rng.randrange(len(ranks)), rng.randrange(len(ranks))) for _ in range(20_000)]
    for text in ("".join(rng.choice("abcdeinorst") for _ in range(9)) for _ in range(4_000)):
        cut = rng.randrange(1, 8)
        pairs += [(ranks[a], ranks[b]) for a, b in ((text[:cut].encode(), text[cut:].encode()),) if a in ranks and b in ranks]
    apart = {p: byte_bpe.merge_by_rank(bpe.tokens[p[0]] + bpe.tokens[p[1]], ranks) == list(p) for p in pairs}
    assert {p: bpe.compatible(*p) for p in pairs} == apart and 100 < sum(apart.values()) < len(apart)


def test_backtracking_against_merges():
    rng = random.Random(3)
    ranks = {bytes([c]): c for c in range(256)}
    while len(ranks) < 320:
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        if len(a + b) < 6 and set(a + b) <= set(b"abc"):
            ranks.setdefault(a + b, len(ranks))
    bpe = byte_bpe.ByteBPE(ranks, r"[abc]+")
    for _ in range(400):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
        expected = [ranks[piece]] if piece in ranks else byte_bpe.merge_by_rank(piece, ranks)
        assert bpe.encode_piece(piece) == expected


def test_token_counts_are_those_of_the_library(spark, empty):
    path = P.path("byte_bpe_50k.json")
    spec, library = byte_bpe.read_ranks(path), Tokenizer.from_file(path)
    texts = ODD + ["a<|endoftext|>b <|endoftext|>"] + random_texts(random.Random(4), 300)
    for r in token_transducer.count_tokens(docs_of(spark, texts), spec).collect():
        text = texts[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 512)
    assert token_transducer.count_tokens(empty, spec).count() == 0
    machine = token_transducer.Transducer(spec, max_transitions=500, max_words=20)
    for text in texts[9:120]:
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert machine.count(text, 7) == n
        if "<|" not in text and text:
            maps = machine.scan([machine.block_map(text[k : k + 9]) for k in range(0, len(text), 9)])
            state, lead = machine.run(machine.initial, maps[-1].lead)
            assert n == lead + state.final + (maps[-1].count + maps[-1].after.final if maps[-1].closed else 0)


def test_all_code_points_are_split_as_by_the_libraries():
    """Each code point beside a letter, a number, a mark and an apostrophe's ending."""
    path = P.path("byte_bpe_50k.json")
    ranks = byte_bpe.parse_ranks(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    tik = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tok, machine, bpe = Tokenizer.from_file(path), token_transducer.Transducer(byte_bpe.read_ranks(path)), byte_bpe.ByteBPE(ranks, P.PATTERN)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x1F000 or c % 64 == 0)]
    points += [c for edges in (*char_classes.LATER_LETTERS, *char_classes.LATER_NUMBERS) for c in range(edges[0] - 1, min(edges[1], edges[0] + 40) + 2)]
    texts = [f"a{chr(c)}'s {chr(c)}1{chr(c)}!{chr(c)}" for c in points]
    own = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, n in zip(texts, own) if machine.count(t) != n] == []
    assert [t for t in texts if memoryview(bpe.encode(t)).cast("I").tolist() != tik.encode_ordinary(t)] == []


# --- near duplicates -------------------------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_banded_alignment():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(6)) if rng.random() < 0.5 or len(b) < 2 else b.pop(rng.randrange(len(b)))
        true = lcs(a, b)
        band = len(a) + len(b) - 2 * true
        assert order_minhash.banded_lcs(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), band) == true


def test_near_duplicates_by_brute_force(spark, empty):
    rng = random.Random(6)
    texts = list(ODD)
    for _ in range(12):
        base = prose(rng, rng.randint(60, 120)).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS) + "x"
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    sh = [order_minhash.shingles(" ".join(re.findall(r"\w+", (t or "").lower()))) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sh[i]) and len(sh[j])
            near = both and (lambda c: c / (len(sh[i]) + len(sh[j]) - c))(lcs(sh[i].tolist(), sh[j].tolist())) >= 0.8
            if near or (not both and not len(sh[i]) and not len(sh[j]) and (texts[i] or "") == (texts[j] or "")):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {k: root(k) for k in range(len(texts))}
    assert order_minhash.near_duplicates(empty).count() == 0
    assert order_minhash.near_deduplicated(docs_of(spark, texts)).count() == len({root(k) for k in range(len(texts))})


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(got[k] == 0 for k in range(31)) and got[102] == 100


# --- decontamination --------------------------------------------------------------------------------


def test_templates():
    tokens, values, maybe = template_decontam.template("Yesterday Maria bought 12 kg of apples. Then Tom paid 3,50 euros.")
    assert tokens == ["yesterday", "\x01name", "bought", "\x01number", "\x01unit", "of", "apples", "then", "\x01name", "paid", "\x01number", "\x01unit"]
    assert values[1] == "maria" and values[3] == "12" and [v for v, m in zip(values, maybe) if m] == ["yesterday", "then"]


def test_contamination(spark, empty):
    item = "Yesterday Maria bought 12 kg of apples at the old market. Then Maria sold 5 kg of them to Tom for 30 dollars in all."
    changed = item.replace("Maria", "Helena").replace("12", "40").replace("Tom", "Igor")
    broken = item.replace("Maria bought", "Helena bought")  # Maria stands for two names: not one replacement
    rng = random.Random(7)
    texts = [prose(rng, 40) + ". " + item + " " + prose(rng, 30), prose(rng, 50) + ". " + changed, broken, prose(rng, 200), None, "", " ".join(item.split()[:6])]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "Why?"), (4, "7 8 9")], "item_id long, text string")
    for block in (500_000, 10):
        got = sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in template_decontam.contaminated(docs_of(spark, texts), bench, block_windows=block).collect())
        assert got == [(0, 1, True), (1, 1, False)]
    assert template_decontam.contaminated(empty, bench).count() == 0 and template_decontam.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert template_decontam.decontaminated(docs_of(spark, texts), bench).count() == 5


def test_names_that_begin_sentences(spark):
    item = "Tom has 12 apples and gives 5 of them away. Tom buys 8 kg more at the market. Tom then eats 2 of the apples. How many apples does Tom have left?"
    other = item.replace("Tom", "Sara").replace("12", "31").replace("5", "7").replace("8", "9")
    mixed = other.replace("Sara buys", "Igor buys").replace("Sara then", "Olga then")
    texts = [item, other, item.lower(), mixed, item.replace("Tom then", "Sara then"), "Sara walks home. " + other + " " + "Who knows? " * 50_000, other, None]
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    hits = template_decontam.contaminated(docs_of(spark, texts), bench).collect()
    assert sorted({(r["doc_id"], r["verbatim"]) for r in hits}) == [(0, True), (1, False), (2, True), (5, False), (6, False)] and len(hits) == 10
    again = docs_of(spark, texts).unionByName(spark.createDataFrame([(0, "clean", "d", "digest", 1)], "doc_id long, text string, keep_id string, node string, kept int"))
    kept = template_decontam.decontaminated(again, bench)
    assert kept.columns == again.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 7]


def test_windows_by_brute_force():
    rng = random.Random(17)
    vocabulary = "the red box of Tom Anna and 3 7 kg How why buys Then sells . ? .".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(3, 14))) for k in range(60)]
    block = template_decontam.Block(items, 4, 0.5)
    named = lambda token, maybe: maybe or token == template_decontam.NAME
    for _ in range(30):
        tokens, values, maybe = template_decontam.template(text(40))
        expected = {}
        for k, (_, own, own_values, _, own_maybe) in enumerate(block.items):
            size = min(4, len(own))
            literal = [sum(t[0] != "\x01" for t in own[i : i + size]) for i in range(len(own) - size + 1)]
            for at in range(len(own) - size + 1):
                for i in range(len(tokens) - size + 1):
                    pairs = [(own[at + d], own_maybe[at + d], tokens[i + d], maybe[i + d]) for d in range(size)]
                    as_names = [a != b for a, _, b, _ in pairs]
                    fits = all(a == b or named(a, m) and named(b, n) for a, m, b, n in pairs)
                    enough = literal[at] - sum(bool(x) and a[0] != "\x01" for x, (a, *_) in zip(as_names, pairs)) >= 2 if size == 4 else None
                    if size == 4 and fits and enough or max(literal) < 0.5 * size and own_values[at : at + size] == values[i : i + size]:
                        expected.setdefault((k, i - at), set()).add(at)
        got = {key: v for key, v in block.found(tokens, values, maybe).items() if len(block.items[key[0]][1]) >= 4 or key in expected}
        assert got == expected


# --- classifiers --------------------------------------------------------------------------------------


def test_quality_held_out(spark, empty):
    rng = random.Random(8)
    good = [prose(rng, rng.randint(20, 80)).capitalize() + "." for _ in range(60)]
    poor = [" ".join(w + rng.choice(["!!", "$$$", "%%%"]) for w in prose(rng, 40).split()).upper() for _ in range(60)]
    texts = [t for pair in zip(good, poor) for t in pair]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, k % 2 == 0 and 2 or 0, 0) for k in range(80)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = ordinal_quality.train_quality(docs, labels, "quality", 3)
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    kept = {r["doc_id"]: r["kept"] for r in ordinal_quality.grade_documents(docs, model).collect()}
    assert sum(kept[k] == (k % 2 == 0) for k in range(80, 120)) >= 39
    assert ordinal_quality.selected(docs, model).count() == sum(kept.values())
    assert ordinal_quality.grade_documents(docs_of(spark, ODD), model).count() == len(ODD) and ordinal_quality.grade_documents(empty, model).count() == 0
    untrained = ordinal_quality.train_quality(docs, labels.limit(0), "quality", 3)
    assert ordinal_quality.selected(docs, untrained).count() == len(texts)


def test_toxicity_held_out(spark, empty):
    rng = random.Random(9)
    bad = [f"{a}{b}" for a in ("grum", "vilk", "skoz") for b in ("a", "esk", "ul")]
    texts = []
    for k in range(200):
        words = prose(rng, rng.randint(20, 200)).split()
        for _ in range(4 if k % 3 == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(140)], "doc_id long, toxic int")
    chain = toxicity_chain.train_toxicity(docs, labels)
    got = {r["doc_id"]: r["toxic"] for r in toxicity_chain.score_toxicity(docs, chain).collect()}
    assert sum(got[k] == (k % 3 == 0) for k in range(140, 200)) >= 58
    assert not any(r["toxic"] for r in toxicity_chain.score_toxicity(docs_of(spark, ODD), chain).collect())
    assert toxicity_chain.score_toxicity(empty, chain).count() == 0
    nothing = toxicity_chain.train_toxicity(docs, labels.limit(0))
    assert not any(r["toxic"] for r in toxicity_chain.score_toxicity(docs, nothing).collect())


def test_facets_are_found_in_the_texts():
    import numpy as np

    rng = random.Random(19)
    kinds = [["alpha", "arrow"], ["beta", "bravo"], ["gamma", "golf"]]
    texts, y = [], []
    for k in range(600):
        words = prose(rng, 40).split()
        if k % 4 == 0:
            words += kinds[k // 4 % 3]
        texts.append(" ".join(words))
        y.append(int(k % 4 == 0))
    rows = Rows([(i, np.ones(len(i))) for i in map(toxicity_chain.features, texts)], toxicity_chain.SIZE)
    found = toxicity_chain.facets(rows, np.array(y))
    which = [tuple(found[k]) for k in range(0, 600, 4)]
    assert not found[np.array(y) == 0].any() and all(sum(w) == 1 for w in which)
    assert all(which[k] == which[k % 3] for k in range(len(which))) and len(set(which[:3])) == 3
    assert not toxicity_chain.facets(rows, np.zeros(600)).any()


def test_chain_of_rated_categories(spark):
    """Rated categories: the chain equals its definition computed row by row, and later categories use earlier ones."""
    import numpy as np

    rng = random.Random(20)
    texts = [" ".join([prose(rng, 30), *(["grum"] if k % 3 == 0 else []), *(["skoz"] if k % 5 == 0 else [])]) for k in range(300)]
    labels = [(k, int(k % 3 == 0), int(k % 5 == 0), int(k % 3 == 0 or k % 5 == 0)) for k in range(300)]
    frame = spark.createDataFrame(labels + [(0, 0, 0, 0), (None, 1, 1, 1), (7, None, 0, 0)], "doc_id long, a int, b int, toxic int")
    docs = docs_of(spark, texts)
    model = toxicity_chain.train_toxicity(docs.unionByName(docs), frame, category_cols=("a", "b"))
    assert model.names == ("a", "b", "toxic") and model.earlier[2, :2].max() > 0
    got = {r["doc_id"]: r for r in toxicity_chain.score_toxicity(docs, model).collect()}
    for k in range(0, 300, 7):
        p = []
        for c in range(3):
            z = sum(model.words[c][i] for i in toxicity_chain.features(texts[k])) + sum(w * q for w, q in zip(model.earlier[c], p)) + model.bias[c]
            p.append(1 / (1 + np.exp(-z)))
        assert [got[k][f"p_{n}"] for n in model.names] == pytest.approx(p, abs=1e-4) and got[k]["toxic"] == (k % 3 == 0 or k % 5 == 0)


def test_ordinal_likelihood_by_brute_force():
    """Among small changes of the fitted weights and thresholds none has a better likelihood."""
    import numpy as np

    rng = np.random.default_rng(21)
    x = rng.normal(size=(200, 3))
    grades = np.clip(np.digitize(x @ [1.0, -0.5, 0.0] + rng.logistic(size=200), [-1, 0.5]), 0, 2)
    rows = Rows([(np.arange(3), r) for r in x], 3)
    model = ordinal_quality.fit_ordinal(rows, grades, 3, steps=3000)

    def loss(w, t):
        tail = 1 / (1 + np.exp(-((x @ w)[:, None] - np.asarray(t)[None, :])))
        p = np.column_stack([np.ones(200), tail]) - np.column_stack([tail, np.zeros(200)])
        return -np.log(p[np.arange(200), grades]).mean() + 0.5e-4 * w @ w

    best = loss(model.weights, model.thresholds)
    for k in range(5):
        for step in (0.05, -0.05):
            w, t = model.weights.copy(), model.thresholds.copy()
            (w if k < 3 else t)[k % 3] += step
            assert loss(w, t) > best - 1e-6
    assert model.tails(np.array([0.3])).shape == (1, 2)


# --- URLs and archives ------------------------------------------------------------------------------


def test_url_rules_and_trees(spark):
    rules = [url_trees.Rule("com/en/", "block"), url_trees.Rule("example.com/en/7", "allow"), url_trees.Rule("net/de/", "allow"), url_trees.Rule("example.net/de/8", "block"), url_trees.Rule("org/es/", "block")]
    cases = {
        "http://A.example.com/en/12?x": ("a.example.com", "/en/12", "com/en/", "block"), "https://a.example.com/en/7#t": ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        "http://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"), "http://xnet/de/1": ("xnet", "/de/1", None, None), "http://h.org?es/": ("h.org", "", None, None),
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), "http://com/en/": ("com", "/en/", "com/en/", "block"),
    }
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(cases)], "page_id long, url string, host string")
    model = url_trees.train_urls(url_trees.rule_labels(pages, rules))
    for r in url_trees.judge_urls(pages, rules, model).collect():
        host, path, rule, verdict = list(cases.values())[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and verdict in (None, r["verdict"])
    rng = random.Random(10)
    urls = [f"https://s{rng.randrange(9)}.example/{'q' * rng.randint(1, 5)}/{rng.randrange(100)}" for _ in range(300)] + [f"http://s{rng.randrange(9)}.example/{rng.randrange(10**9)}{rng.randrange(10**9)}?a=1&b={rng.randrange(99)}&c=3" for _ in range(300)]
    y = [0] * 300 + [1] * 300
    fitted = url_trees.fit_boosted(urls[::2], y[::2])
    assert ((fitted.probability(urls[1::2]) >= 0.5) == [bool(v) for v in y[1::2]]).mean() > 0.97
    assert url_trees.judge_urls(pages.limit(0), rules, model).count() == 0


def test_trees_split_as_brute_force_would():
    """The first split of a tree is the best of all splits at the bounds, and leaves are Newton steps."""
    import numpy as np

    rng = np.random.default_rng(22)
    x = rng.normal(size=(120, 3))
    g, h = rng.normal(size=120), rng.uniform(0.1, 0.3, size=120)
    bounds = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 9)[1:-1])) for f in range(3)]
    binned = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)], axis=1)
    tree = url_trees._grow(x, binned, bounds, g, h, 1, 0.3)
    gain = {(f, b): sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (x[:, f] <= b, x[:, f] > b)) for f in range(3) for b in bounds[f]}
    f, b = max(gain, key=gain.get)
    left = x[:, f] <= b
    assert (tree.feature[0], tree.bound[0]) == (f, b)
    assert tree.value.tolist() == pytest.approx([-0.3 * g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])
    assert tree.predict(x).tolist() == pytest.approx([tree.value[0] if m else tree.value[1] for m in left])


def test_long_and_repeated_urls(spark):
    rules = [url_trees.Rule("com/en/", "block"), url_trees.Rule("net/de/", "allow")]
    long = "http://a.com/en/" + "x" * 200_000
    pages = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (2, "http://" + "h." * 5_000 + "com/en/", "c"), (None, None, "d")], "page_id long, url string, verdict string")
    got = url_trees.judge_urls(pages, rules, url_trees.train_urls(url_trees.rule_labels(pages, rules))).collect()
    assert sorted((r["page_id"] or 0, r["rule"] or "", r["verdict"]) for r in got) == [(0, "", "allow"), (1, "com/en/", "block"), (1, "com/en/", "block"), (2, "com/en/", "block")]


def test_archives_round_trip(spark):
    pages = [(k, f"https://www.h{k % 4}.example:80/a b/{k}?q=é", "" if k % 9 == 0 else f"<p>{'body ' * (k % 7)}</p>\r\n\r\nx") for k in range(60)] + [(100, None, None), (101, "no scheme", "own"), (None, "http://n.example/", "only null")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    for least in (0, 5):
        got = warc_index.archive_and_read(frame, min_bytes=least).collect()
        assert len(got) == len(pages)
        bodies = {p: (b or "").encode() for p, _, b in pages}
        for r in got:
            body = bodies[r["page_id"]]
            first = min((p for p, b in bodies.items() if b == body and p is not None), default=None)
            revisit = len(body) >= least and r["page_id"] is not None and first != r["page_id"]
            assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(body), warc_index.payload_digest(body), "revisit" if revisit else "response", first if revisit else None)
    assert warc_index.archive_and_read(frame.limit(0)).count() == 0


def test_archives_keep_any_id(spark):
    """String ids with odd characters, repeated rows, clashing columns and a long page."""
    ids = ["-", "", "a b", "x>y\nz", "é", None, "null", "id:1", "dup", "dup"]
    pages = [(p, f"http://h.example/{k % 3}", f"body {k}" if k < 8 else "the same", "file", "key") for k, p in enumerate(ids)] + [("long", "http://h.example/l", "é" * 400_000, "", "")]
    frame = spark.createDataFrame(pages, "page_id string, url string, html string, file string, key string").repartition(3)
    got = warc_index.archive_and_read(frame).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(p[0]) for p in pages)
    bodies = {p[0]: p[2].encode() for p in pages}
    assert all((r["payload_digest"], r["payload_bytes"], r["record_type"]) == (warc_index.payload_digest(bodies[r["page_id"]]), len(bodies[r["page_id"]]), "response") for r in got)


def test_index_lookup(spark):
    frame = spark.createDataFrame([(k, f"http://h{k % 50}.example/{k}", f"b{k}") for k in range(400)], "page_id long, url string, html string")
    index = warc_index.CaptureIndex.build(warc_index.write_archives(frame), block_lines=16)
    search = warc_index.Searcher(index)
    for k in (0, 7, 399):
        (hit,) = search.captures(warc_index.line_key(f"http://h{k % 50}.example/{k}", k))
        assert search.record(hit[1], int(hit[2]), int(hit[3]))[2] == f"b{k}".encode()
    assert search.captures("zzz 1") == [] and search.captures("") == []
    assert warc_index.url_key("http://WWW.a.org:8080/p?q") == "org,a,www:8080)/p?q"


# --- personal data ------------------------------------------------------------------------------------


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def test_surrogates(spark, empty):
    texts = [
        "write hein.19@mail5.example.com or HEIN.19@mail5.example.com, call +1 (743) 555-3824", "again hein.19@mail5.example.com and other.20@mail5.example.com",
        "card 4111 1111 1111 1111, 4111111111111112; ip 97.51.17.173", "Ms. Emily Carter met Dr. Carter; James Carter; Анна Петрова", 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', "clean text 12, 3.5 and 2024", None, "",
    ]
    rows = {r["doc_id"]: r for r in pii_surrogates.replace_pii(docs_of(spark, texts), "k").collect()}
    find = lambda k: re.findall(pii_surrogates.PATTERNS["email"].replace("*+", "*"), rows[k]["text"])
    a, b = find(0), find(1)
    assert a[0] == b[0] and a[0].lower() == a[1].lower() and b[0] != b[1] and a[0].endswith(".com") and "hein" not in rows[0]["text"]
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}$", rows[0]["text"]) and "743" not in rows[0]["text"]
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", rows[2]["text"])
    assert luhn(cards[0].replace(" ", "")) and not luhn(cards[1]) and cards[0] != texts[2][5:24]
    assert all(int(x) < 256 for x in re.search(r"ip ([\d.]+)$", rows[2]["text"])[1].split("."))
    title, first, last = re.match(r"(Ms\.) (\w+) (\w+) met", rows[3]["text"]).groups()
    assert first in pii_surrogates.FIRST_NAMES["latin", "female"] and first != "Emily" and f"Dr. {last};" in rows[3]["text"]
    assert re.search(r"; (\w+) \w+; ", rows[3]["text"])[1] in pii_surrogates.FIRST_NAMES["latin", "male"] and re.search("[А-Я][а-я]+ [А-Я][а-я]+$", rows[3]["text"])
    assert re.search(r'"[0-9A-F]{40}"', rows[4]["text"]) and rows[4]["text"] != texts[4]
    assert [rows[k]["text"] for k in (5, 6, 7)] == texts[5:] and rows[6]["n_entities"] == 0
    assert pii_surrogates.replace_pii(empty, "k").count() == 0


def test_surrogates_stay_distinct(spark):
    rng = random.Random(11)
    phones = sorted({f"{rng.randrange(100, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}" for _ in range(400)})
    out = [r["text"] for r in pii_surrogates.replace_pii(docs_of(spark, phones), "k").collect()]
    assert len(set(out)) == len(phones) and not set(out) & set(phones)


def test_surrogate_exceptions_by_join(spark):
    texts = spark.createDataFrame([(1, "a x@y.com b x@y.com c z@y.com", "k"), (2, "none", "k"), (3, "Dr. Emily Carter and Carter", "k"), (3, "Dr. Emily Carter and Carter", "k")], "id long, body string, key string")
    redrawn = spark.createDataFrame([("x@y.com", "new@q.com"), ("Carter", "Xylo")], "e string, s string")
    found = pii_surrogates._replaced_by_join(texts, redrawn, "k", "doc_id").collect()
    rows = {r["doc_id"]: r["text"] for r in found}
    assert len(found) == 4 and rows[1].count("new@q.com") == 2 and "z@y" not in rows[1] and rows[2] == "none"
    assert re.fullmatch(r"Dr\. [A-Z][a-z]+ Xylo and Xylo", rows[3]) and "Emily" not in rows[3]


def test_names_keep_their_form(spark):
    texts = [
        "Emily Carter wrote. Emily's friend James O'Brien met Carter, EMILY CARTER and Marie-Claire McDonald. CARTER left; Emilyx, xEmily stay.",
        "Mr. Jean-Luc saw Emily in Carter city.", "Emily went home.", "Dr. Li and Dr. Xu and Mr Al " * 20_000, "Dr. Li", "Dr. Xu",
    ]
    rows = {r["doc_id"]: r["text"] for r in pii_surrogates.replace_pii(docs_of(spark, texts), "k").collect()}
    first, last = re.match(r"(\w+) (\w+) wrote", rows[0]).groups()
    assert first in pii_surrogates.FIRST_NAMES["latin", "female"] and first != "Emily" and f"{first}'s friend" in rows[0]
    assert f" met {last}, {first.upper()} {last.upper()} and" in rows[0] and f"{last.upper()} left; Emilyx, xEmily stay." in rows[0]
    assert re.search(r"friend [A-Z][a-z]+ [A-Z]'[A-Z][a-z]{4} met", rows[0]) and re.search(r"and [A-Z][a-z]+-[A-Z][a-z]+ [A-Z][a-z][A-Z][a-z]{5}\.", rows[0])
    assert not re.search("Carter|CARTER|Brien|McDon|Marie|James", rows[0])
    assert re.fullmatch(r"Mr\. [A-Z][a-z]{3}-[A-Z][a-z]{2} saw Emily in Carter city\.", rows[1]) and rows[2] == texts[2]
    vowels = [c in "aeiou" for c in last.lower()]
    assert vowels == [c in "aeiou" for c in "carter"]
    assert len(rows[3]) >= len(texts[3]) and rows[4] != rows[5] and rows[3].startswith(rows[4] + " and " + rows[5] + " and ")


def test_names_with_few_surrogates_stay_distinct(spark):
    """Every name of a format is taken: the later draws are longer."""
    names = [f"{a}{b}" for a in "BCDFGHJKLMNPQRSTVWXYZ" for b in "aeiou"]
    texts = [f"Mr. {n}" for n in names]
    rows = {r["doc_id"]: r["text"] for r in pii_surrogates.replace_pii(docs_of(spark, texts), "k").collect()}
    assert len(set(rows.values())) == len(names) and not set(rows.values()) & set(texts)


def test_the_key_is_in_no_plan(spark):
    texts = ["192.0.2.1", "Dr. Carter"]
    plan = pii_surrogates.replace_pii(docs_of(spark, texts), "hidden-key")._jdf.queryExecution().toString()
    assert "hidden-key" not in plan


def test_sparse_rows():
    import numpy as np

    rows = Rows([(np.array([0, 2]), np.array([1.0, 2.0])), (np.array([], dtype=int), np.array([])), (np.array([1]), np.array([3.0]))], 3)
    assert rows.dot(np.array([1.0, 1.0, 1.0])).tolist() == [3.0, 0.0, 3.0] and rows.take(np.array([False, False, True])).t_dot(np.array([2.0])).tolist() == [0.0, 6.0, 0.0]


def test_components_joined_by_further_links(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node int, label int")
    found = spark.createDataFrame([(2, 6), (1, 6), (6, 9), (11, 12)], "a int, b int")
    got = {r["label"]: r["to_label"] for r in order_minhash._joined_components(found, labels).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 11: 11, 12: 11}


def test_short_near_duplicates_are_all_found(spark):
    """A text of 8 words and itself with one word more: 4 shingles of 5, at the threshold."""
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {k: k - k % 2 for k in range(len(texts))}


def test_prefixes_leave_out_no_link():
    import numpy as np

    rng = random.Random(6)
    counts = np.zeros(order_minhash.SLOTS, dtype=np.int64)
    for n in [*range(5, 40), 100, 400]:
        a = [f"w{rng.randrange(30 if n % 2 else 10**6)}" for _ in range(n)]
        for _ in range(20):
            b = list(a)
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(b))
                b[k : k + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(2)
            x, y = sorted((order_minhash.shingles(" ".join(t)) for t in (a, b)), key=len)
            counts[rng.randrange(len(counts))] += 3
            if order_minhash.alignment_similarity(x, y) >= 0.8:
                x, y = (order_minhash.rarest_first(order_minhash.labelled(h), counts) for h in (x, y))
                small, large = x[: order_minhash.prefix_length(len(x), 1.6 / 1.8)].tolist(), y[: order_minhash.prefix_length(len(y), 0.8)].tolist()
                first = next(k for k, h in enumerate(small) if h in large)
                assert min(len(x) - first, len(y) - large.index(small[first])) >= 0.8 / 1.8 * (len(x) + len(y)) - 1e-6


def test_family_around_the_threshold(spark):
    """One base, a few hundred edited copies, many of their pairs just over and under 0.8; the base is not there."""
    rng = random.Random(16)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 6))):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy[rng.randrange(3) :]))
    sh = [order_minhash.shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if order_minhash.alignment_similarity(sh[i], sh[j]) >= 0.8:
                links += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert 100 < links < len(texts) ** 2 / 3
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {k: root(k) for k in range(len(texts))}


def test_bit_filter(spark):
    from textloom.llm.bit_filter import bit_filter, may_contain, surely_absent

    rows = spark.range(20_000).withColumnRenamed("id", "k").repartition(3)
    known = bit_filter(rows.where("k % 10 = 0").select(F.xxhash64("k").alias("h")))
    assert known.count() == 512
    passed, absent = may_contain(rows, F.xxhash64("k"), known), surely_absent(rows, F.xxhash64("k"), known)
    assert passed.columns == ["k"] and passed.where("k % 10 = 0").count() == 2_000 and passed.count() < 2_050
    assert passed.count() + absent.count() == 20_000
    assert may_contain(rows, F.xxhash64("k"), bit_filter(rows.limit(0).select(F.xxhash64("k").alias("h")))).isEmpty()


def test_every_occurrence_of_an_item_is_judged():
    item = "She bought 12 red apples and then 12 green apples and then 12 ripe pears for the party"
    mixed = item.replace("12 red", "3 red").replace("12 green", "4 green")
    block = template_decontam.Block([(1, item)], 8, 0.5)
    assert list(block.hits(mixed, 0.5)) == []
    filler = " ".join(f"word{chr(97 + k % 26)}" for k in range(300))
    for between in (filler, "so"):
        (hit,) = block.hits(f"{mixed}. {between}. {item}", 0.5)
        assert hit[0] == 1 and hit[2] == 1.0 and hit[3]
    # of the last occurrence only a part is left; the first, near it, must not spoil it
    (hit,) = block.hits(f"{mixed}. So {item[len('She bought '):]}", 0.5)
    assert 0.5 <= hit[2] < 1.0 and hit[3]


def test_suffix_statistics_are_of_all_labelled_urls(spark):
    urls = [f"http://h{k}.site{k % 7}.org/{k}" for k in range(200)]
    y = [int(k % 7 < 3) for k in range(200)]
    rows = spark.createDataFrame(list(zip(urls, y)), "url string, blocked int").repartition(3)
    model = url_trees.train_urls(rows.unionByName(rows.limit(9)), max_rows=20)
    assert model.suffixes == url_trees.suffix_statistics(urls, y) and model.trees
