import base64
import hashlib
import random
import re
import sys
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from compare import connect, rows, sql_rows  # noqa: E402

from lodestone.llm import bpe, chat, decontaminate, fingerprint, language, line_dedup, near_dedup, pii, queries, toxicity, url_filter  # noqa: E402
from lodestone.llm.components import components  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"w{i}" for i in range(300)]


def sentence(draw, n):
    return " ".join(draw.choice(VOCABULARY) for _ in range(n))


def table(spark, texts, **more):
    return spark.createDataFrame([(i, t, more.get("lang"), "s", None if t is None else len(t)) for i, t in texts], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, blanks, repeats, one very long text."""
    return table(spark, [(1, None), (2, ""), (3, " \n\n "), (4, "one"), (5, "a b c d e f"), (6, "a b c d e f"), (7, "word " * 40_000), (None, "lost"), (8, "A B C D E F"), (8, "a b c d e f")])


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, small, con, name):
    assert rows(queries.QUERIES[name](spark, small)) == sql_rows(con, queries.SQL[name])


# 1: byte-level BPE


def test_bpe_is_the_library(spark, small, odd):
    import tiktoken

    path, pattern = bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text").where("doc_id <> 10008"))
    docs = docs.unionByName(spark.createDataFrame([(20_000, "x" * 9000), (20_003, "".join(random.Random(6).choice("abcdefghijklmnop") for _ in range(5000))), (20_001, "ab" * 900 + "é" * 700), (20_002, "<|endoftext|> 漢字🙂\x00")], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = bpe.tokenize(docs.withColumns({"ids": F.lit(1), "n_tokens": F.lit("x")}), path, pattern).collect()
    assert len(got) == docs.count() and bpe.tokenize(docs.limit(0), path, pattern).count() == 0
    for r in got:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# 2: chat formatting


def test_chat_parts_and_round_trip(spark):
    part = lambda kind, **x: {k: x.get(k) for k in ("text", "ref", "width", "height", "seconds", "pages")} | {"kind": kind}
    parts = [part("text", text="see <|image:0|> \\ |"), part("image", ref="i.png", width=28, height=15), part("audio", ref="a", seconds=0.5), part("document", ref="d", pages=2)]
    out, a, b, attached, tokens = chat.format_turn("assistant", parts)
    assert [(x["ordinal"], x["kind"], x["tokens"]) for x in attached] == [(0, "image", 4), (1, "audio", 13), (2, "document", 1200)]
    assert tokens == 5 + 4 + 13 + 1200 and out[a:b].endswith("<|image:0|><|audio:1|><|document:2|>")
    for role, text in product(("user", "a\nb\\|", ""), (chat.TRICK, "\\", "\\n|", "", "<|im_end|>\n<|im_start|>user\n")):
        made = chat.format_turn(role, [part("text", text=text)])[0]
        assert [(r, t) for r, t, _ in chat.read_turns(made)] == [(role, text)]
    with pytest.raises(ValueError):
        chat.format_turn("user", [part("video")])
    turns = spark.createDataFrame([(1, 0, None, None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(turns.withColumn("parts", chat.text_parts()))).count() == 2


def test_chat_loss_is_read_from_the_mask_and_attachments_count_through_a_conversation(spark):
    rows = [(1, 0, "user", [("image", None)]), (1, 1, "assistant", [("text", "<|image:0|> said"), ("image", None)]), (1, 2, "user", [("audio", None), ("text", "x")]), (2, 0, "user", [("document", None)])]
    turns = spark.createDataFrame([(c, t, r, [(k, x, None, 14, 14, 1.0, 1) for k, x in parts]) for c, t, r, parts in rows], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    made = chat.format_turns(chat.number_attachments(turns), "first")
    got = {(r.conv_id, r.turn): r for r in made.collect()}
    assert {k: [a.ordinal for a in r.attachments] for k, r in got.items()} == {(1, 0): [0], (1, 1): [1], (1, 2): [2], (2, 0): [0]}
    assert list(chat.read_parts(got[1, 1].formatted)) == [("assistant", [("text", "<|image:0|> said"), ("image", 1)], True)]
    loss = lambda df: {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat.read_back(df).collect()}
    want = "<|image:0|> said<|image:1|>"
    assert loss(made)[1] == (len(want), hashlib.sha256(want.encode()).hexdigest())
    assert loss(made.withColumn("loss_end", F.col("loss_start")))[1] == (0, hashlib.sha256(b"").hexdigest())


# 3: decontamination


def test_leaks_are_found_exact_and_edited_and_nothing_else(spark, odd):
    draw = random.Random(5)
    items = [(i, sentence(draw, draw.randint(12, 60))) for i in range(30)] + [(98, None), (99, "")]
    texts, want = [], set()
    for k in range(120):
        words = sentence(draw, 150).split()
        if k % 3 == 0:
            i = draw.randrange(30)
            own = items[i][1].split()
            for _ in range(int(0.1 * len(own)) if k % 2 else 0):
                own[draw.randrange(len(own))] = "zz"
            words[40:40] = own
            want.add((100 + k, i))
        texts.append((100 + k, " ".join(words)))
    docs = table(spark, texts).unionByName(odd)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    exact = {(d, i) for d, t in texts for i, x in items[:30] if decontaminate.best_match(decontaminate.hash_words(x.encode()), decontaminate.hash_words(t.encode()))[0] <= int(decontaminate.TOLERANCE * len(x.split()))}
    assert got <= exact and want <= exact and len(got & exact) >= 0.97 * len(exact)
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench, block=10).collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in got}
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_leaks_with_words_put_in_left_out_and_replaced(spark):
    draw = random.Random(11)
    items = [(i, " ".join(f"v{draw.randrange(3000)}" for _ in range(draw.randint(15, 60)))) for i in range(40)]
    texts, near = [], 0
    for k in range(160):
        own = items[k % 40][1].split()
        for _ in range(int(0.18 * len(own))):
            at, how = draw.randrange(len(own)), (k // 40) % 4
            own[at : at + 1] = ([], [own[at], "put"], ["new"], draw.choice(([], [own[at], "put"], ["new"])))[how]
        text = " ".join([f"u{draw.randrange(3000)}" for _ in range(60)] + own + ["end"] * 20)
        near += decontaminate.best_match(decontaminate.hash_words(items[k % 40][1].encode()), decontaminate.hash_words(text.encode()))[0] <= int(0.2 * len(items[k % 40][1].split()))
        texts.append((k, text))
    docs, bench = table(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs.withColumn("item_id", F.lit("x")), bench).collect()}
    assert near >= 120 and len(got) >= 0.95 * near and all(d % 40 == i for d, i in got)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, block=15).collect()} == got


# 4: fingerprints


def word_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints_and_edits(spark, odd):
    draw = random.Random(3)
    texts = [(i * 37 - 900, sentence(draw, draw.randint(0, 500))) for i in range(80)] + [(5_000_000, "é" * 7), (9_000_000_000, "x y z")]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in fingerprint.edit_likeness(docs).collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        h = len(t) // 2
        e = t[: len(t) - h] + after[:h]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b = word_set(t), word_set(e)
        if a and b:
            errors.append(got[d].near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).mean() < 0.05
    odds = fingerprint.edit_likeness(odd).collect()
    assert len(odds) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in odds)
    assert len({r.fingerprint for r in odds if r.doc_id in (5, 6)}) == 1
    assert fingerprint.edit_likeness(odd.limit(0)).count() == 0


def test_fingerprint_equals_its_definition(spark):
    """The densified sketch against a plain loop over the same shingle hashes."""
    docs = spark.createDataFrame([(1, sentence(random.Random(1), 60)), (2, "a b"), (3, sentence(random.Random(2), 900))], "doc_id long, text string")
    for r in docs.select("doc_id", fingerprint.shingle_hashes(F.col("text")).alias("h"), fingerprint.packed(F.col("text")).alias("p")).collect():
        bins = {}
        for x in r.h:
            b = ((x >> 56) + 128) & 255
            bins[b] = min(bins.get(b, x), x)
        full = {b: x & 15 for b, x in bins.items()}
        digits = "".join(f"{x & (2**64 - 1):016x}" for x in r.p)
        assert all(int(digits[b], 16) == v for b, v in full.items())
        assert {int(c, 16) for c in digits} == set(full.values())


# 5: language


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 4])
    emit, first, move = rng.normal(size=(8, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    p, logs, pairs = language.marginals(emit, np.array([0, 3, 4]), lengths, first, move)
    at, want_pairs = 0, np.zeros((3, 3))
    for c, n in enumerate(lengths):
        scores = {}
        for path in product(range(3), repeat=n):
            scores[path] = np.exp(first[path[0]] + sum(emit[at + i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
        z = sum(scores.values())
        assert np.isclose(np.log(z), logs[c])
        for i, y in product(range(n), range(3)):
            assert np.isclose(p[at + i, y], sum(s for path, s in scores.items() if path[i] == y) / z)
        for path, s in scores.items():
            for a, b in zip(path, path[1:], strict=False):
                want_pairs[a, b] += s / z
        at += n
    assert np.allclose(pairs, want_pairs)


def test_held_out_languages_and_code_switching(spark, small, odd):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.train(docs, ~language.held_out())
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out())
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    by = {r.lang: r.text for r in docs.where(language.held_out() & F.col("lang").isin("de", "fr")).collect()}
    de, fr = (" ".join(language.words_of(by[x])[:30]) for x in ("de", "fr"))
    p, lengths = language.Labeller(model).words([f"{de} {fr}"])
    labels = [model.labels[i] for i in p.argmax(axis=1)]
    half = len(language.words_of(de))
    assert labels[:half].count("de") >= 0.9 * half and labels[half:].count("fr") >= 0.9 * (lengths[0] - half)
    digits = table(spark, [(1, "½ ² Ⅷ ① 12"), (2, "_ 3"), (3, "½x")])
    assert {r.doc_id: (r.lang_pred == "und", r.score == 0) for r in language.predict(digits, model).collect()} == {1: (True, True), 2: (True, True), 3: (False, False)}
    assert odd.where(language.held_out().isNull()).count() == 0
    odds = {r.doc_id: r.lang_pred for r in language.predict(odd, model).collect()}
    assert odds[1] == odds[2] == odds[3] == "und" and odds[4] != "und"
    assert language.train(docs.limit(0)) is None and language.predict(odd, None).where("lang_pred <> 'und'").count() == 0


# 6: line dedup


def test_line_dedup_against_a_loop(spark, odd):
    draw = random.Random(9)
    texts = [(i, "\n".join(draw.choice("abcdefg") for _ in range(draw.randint(0, 14)))) for i in range(60)] + [(90, None), (91, "\n\n\n\n")]
    seen, gone = set(), {}
    for d, t in sorted(texts):
        lines = [] if t is None else t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip(" ") for x in w):
                if w in seen:
                    gone.setdefault(d, set()).update((p, p + 1, p + 2))
                seen.add(w)
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in texts if t is None or len(gone.get(d, ())) < len(t.split("\n"))}
    got = line_dedup.dedup_lines(table(spark, texts))
    assert {r.doc_id: r.text for r in got.collect()} == want and got.columns == [x.split()[0] for x in DOC.split(", ")]
    assert line_dedup.dedup_lines(odd).count() == odd.count()


def test_line_dedup_tells_texts_of_one_id_apart_and_takes_any_column_names(spark):
    texts = [(1, "a\nb\nc"), (2, "a\nb\nc\nq"), (2, "k\nl\nm\nn"), (3, "z"), (2, "k\nl\nm\nn")]
    docs = table(spark, texts).withColumns({"gone": F.lit("g"), "__id": F.lit(5), "ID_": F.lit("i"), "hash_": F.lit("h"), "left_": F.lit(1), "gone_": F.lit(2)})
    got = line_dedup.dedup_lines(docs)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a\nb\nc"), (2, "k\nl\nm\nn"), (2, "k\nl\nm\nn"), (2, "q"), (3, "z")]
    assert got.columns == docs.columns and got.where("gone = 'g' and __id = 5 and left_ = 1 and gone_ = 2").count() == 5
    crowd = table(spark, [(i, "one\ntwo\nthree\n" + str(i)) for i in range(300)])
    assert sorted(r.text for r in line_dedup.dedup_lines(crowd).collect()) == sorted(["one\ntwo\nthree\n0"] + [str(i) for i in range(1, 300)])
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# 7: near duplicates


def brute_components(texts, percent=75):
    sets = {}
    for d, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates_against_all_pairs(spark, odd):
    draw = random.Random(4)
    texts, quote = [], sentence(draw, 60)
    for k in range(25):
        base = sentence(draw, draw.randint(1, 80)).split()
        for j in range(draw.randint(1, 5)):
            w = list(base)
            if j and len(w) > 3:
                w[draw.randrange(len(w))] = f"x{k}{j}"
            texts.append((len(texts), " ".join(w).upper() if j == 2 else " ".join(w)))
    texts += [(500 + i, f"{quote} {sentence(draw, 12)}") for i in range(50)]  # a crowd about one passage
    crowd = sentence(draw, 200).split()
    for i in range(90):  # copies of a text that isn't there, some too far from each other, some from all
        w = list(crowd)
        for _ in range(draw.randint(0, 12)):
            w[draw.randrange(len(w))] = f"y{i}{draw.randrange(5)}"
        texts.append((1000 + i, " ".join(w)))
    texts += [(700, None), (701, ""), (702, " \t")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_components(texts)
    groups = Counter(c for d, (_, c) in got.items() if d >= 1000)
    assert max(groups.values()) > 30 and min(groups.values()) == 1
    again = [(1, "a b c d e f g"), (1, sentence(draw, 40)), (2, "h i j k l m n"), (3, "A b c d e f g"), (4, "h i j k l m n")]
    again += [(1, "h i j k l m n"), (7, again[1][1])]  # one id with three texts holds their groups together
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, again)).collect()} == dict.fromkeys((1, 2, 3, 4, 7), 1)
    kept = near_dedup.keep_one(odd)
    assert {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 7}
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(50)}


# 8: URL filter


def test_url_rules_against_a_loop(spark):
    draw = random.Random(2)
    hosts = ["a.net", "net", "example.net", "x.example.net", "badexample.net", "example.com", "b.example.com", "org", "q.org", "Q.ORG", ""]
    urls = [None, "nothing", "://", "http://org?x", "HTTP://Example.NET/en/x://y#z"] + [f"http://{draw.choice(hosts)}{draw.choice(['', '/', '/en/a', '/de/', '/fr/x?y', '/en', '/DE/'])}" for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filter.rule_table(spark, url_filter.RULES)
    want = {}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        want[i] = (host, path, best[1], best[2])
    assert url_filter.shards(4, 1000) == 1 and url_filter.shards(10**9, 10**10) > 1
    for most in (url_filter.BROADCAST_BYTES, 2):  # the second splits each list into several cascades
        got = url_filter.judge(pages, rules, most_bytes=most).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want and len(got) == len(urls)
    long = spark.createDataFrame([(1, "http://" + "a." * 200_000 + "net/" + "x" * 200_000), (2, "http://" + "." * 300_000), (2, None)], "page_id long, url string")
    assert sorted((r.page_id, r.rule) for r in url_filter.judge(long.withColumn("host", F.lit(1)), rules).collect() if r.rule) == [(1, "net/")]
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert url_filter.judge(pages, rules.limit(0)).where("rule is not null").count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"), "id")
    cascade = url_filter.build(universe.where("id % 7 = 0"), universe)
    r = universe.toPandas()
    assert np.array_equal(cascade.holds(r["a"].to_numpy().view(np.uint64), r["b"].to_numpy().view(np.uint64)), r["id"].to_numpy() % 7 == 0)


# 9: toxicity


def test_held_out_toxicity(spark, odd):
    folder = "/root/testdata/sf0.1"
    rows_ = toxicity.op9_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    toxic, clean = [[r for r in rows_ if r.toxic == k] for k in (1, 0)]
    assert np.mean([r.predicted for r in toxic]) >= 0.85 and np.mean([r.predicted for r in clean]) <= 0.08
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").limit(400), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels)
    marked = docs.limit(50).withColumns({"score": F.lit(0.77), "Predicted": F.lit("p")})
    left = toxicity.reject_toxic(marked, labels)
    assert left.columns == marked.columns and left.where("score <> 0.77 or Predicted <> 'p'").count() == 0
    assert not any(r.held_out is None for r in odd.select(toxicity.held_out().alias("held_out")).collect())
    scored = toxicity.score_texts(odd.withColumn("score", F.lit("x")), model)
    assert scored.count() == odd.count() and scored.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score_texts(odd, toxicity.train(docs, labels.limit(0))).where("predicted = 1").count() == 0


def test_the_risk_never_goes_negative_on_separable_data():
    """Feature 0 marks the positives and the tenth of the unlabelled texts that are like them."""
    at = lambda n, marked: (np.concatenate([np.zeros(marked, int), np.arange(n) % 40 + 1]), np.concatenate([np.arange(marked), np.arange(n)]), n)
    m = toxicity.fit_nnpu(at(40, 40), at(330, 30), ["bad", *(f"n{i}" for i in range(40))], 0.1)
    assert m.score("bad") > 0.5 > m.score("fine")


def test_toxicity_without_a_feature_that_stands_out(spark):
    docs = table(spark, [(i, sentence(random.Random(i), 8)) for i in range(60)])
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(60)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert not model.weights and toxicity.score_texts(docs, model).where("predicted = 1").count() == 0
    nothing = (np.empty(0, int), np.empty(0, int), 6)
    assert abs(toxicity.fit_nnpu(nothing, (*nothing[:2], 60), [], 0.1).score("x") - 0.1) < 1e-6


def test_the_scores_are_a_plain_sum_and_the_risk_falls(spark):
    model = toxicity.PuModel({"ab": 1.0, "abcd*": 0.5, "é": -2.0}, -1.0)
    texts = ["", None, "ab", "AB ab", "abcdef é", "zz"]
    got = toxicity.score_texts(table(spark, list(enumerate(texts))), model).orderBy("doc_id").collect()
    assert [r.score for r in got] == [model.score(t) for t in texts]
    assert np.allclose(model.score("abcdef é"), 1 / (1 + np.exp(2.5)))
    draw = np.random.default_rng(1)
    x = draw.random((200, 6)) < np.linspace(0.1, 0.6, 6)
    p, u = x[:60] | (draw.random((60, 6)) < 0.3), x
    sparse = lambda a: (np.nonzero(a)[1], np.nonzero(a)[0], len(a))

    def risk(m):
        w = np.array([m.weights.get(str(i), 0) for i in range(6)])
        loss = lambda a, y: np.logaddexp(0, -y * (a @ w + m.bias)).mean()
        return 0.2 * loss(p, 1) + max(0, loss(u, -1) - 0.2 * loss(p, -1))

    names = [str(i) for i in range(6)]
    fitted, first = (toxicity.fit_nnpu(sparse(p), sparse(u), names, 0.2, steps=n) for n in (250, 1))
    assert risk(fitted) < risk(first)


# 10: personal data


def naive(text):
    """The base patterns as they are stated."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if low <= len(digits) <= high and (kind == 3 or luhn):
                out.append((kind, *m.span()))
    return sorted(out)


def test_base_spans_are_the_stated_patterns(small):
    draw = random.Random(8)
    texts = ["".join(draw.choice(["1", "25", "4", ".", "-", " ", "@", "a", "b.c", "+", "(", "4111 1111 1111 1111", "é"]) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    for t in [*texts, "a@b.c-d@e.f", "300.1.1.1.2.3", "1.2.3.4.5.6.7.8", "+1 (234) 555-0000.", "x" * 50_000 + "@", "9" * 50_000]:
        assert sorted(pii.base_spans(t)) == naive(t) if len(t) < 1000 else pii.base_spans(t) is not None


def test_voting_adds_spans_and_keeps_base_ones(spark, odd):
    good = [(i, f"Please call my phone 0{i % 10}1{i % 7} 555 12{i % 10}4 today, or mail jo{i} at site{i} dot com now. Card visa 4111 1111 1111 1111 and host 10.0.0.{i % 200}.") for i in range(200)]
    docs = table(spark, good).unionByName(odd)
    rows_ = pii.find_spans(docs).collect()
    assert len(rows_) == docs.count()
    texts = dict(good)
    added = [x for r in rows_ if r.doc_id in texts and r.doc_id > 10 for x in r.added]
    assert all(sorted((x.kind, x.start, x.end) for x in r.base) == naive(texts[r.doc_id]) for r in rows_ if (r.doc_id or 0) > 10)
    assert added and all(0 <= x.start < x.end for x in added)
    assert pii.find_spans(odd.limit(0)).count() == 0
    assert pii.redact("a b@c.de f", [(0, 2, 8)]) == "a <email> f"


def test_personal_data_query_by_brute_force_and_secrets(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    kinds = pii.KINDS
    caught, planted = 0, 0
    for r in pii.op10_pii(spark, small).collect():
        own = naive(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in own) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for k, s, e in own).encode()).hexdigest()
        spans = [(kinds.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans) and set(own) <= set(spans) and len(spans) == r.n_spans == r.n_added + len(own)
        planted += 'token = "' in texts[r.doc_id]
        caught += 'token = "' in texts[r.doc_id] and any(k == 5 for k, _, _ in spans)
    assert caught == planted
    docs = table(spark, [(i, f'api key = "{hashlib.sha1(str(i).encode()).hexdigest()}" was used') for i in range(80)] + [(100 + i, f"commit {hashlib.sha1(str(i).encode()).hexdigest()} and a_long_name_of_a_function_{i}") for i in range(80)])
    found = {r.doc_id: [x.kind for x in r.added] for r in pii.find_spans(docs.withColumns({"base": F.lit(1), "kind": F.lit("k")})).collect()}
    assert all(found[i] == [5] for i in range(80)) and not any(found[100 + i] for i in range(80))


def test_em_learns_which_labelers_to_trust():
    patterns = [(0, "++", 500), (0, "--", 500), (0, "+-", 40), (0, "-+", 4)]
    q = pii.estimate(patterns)
    assert q[0, "++"] > 0.95 and q[0, "--"] < 0.05


# the pipeline


def test_pipeline_is_its_stages_and_drops_what_each_says(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, texts = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == names, name
        texts = {r.doc_id: r.text for r in docs.collect()}
        if name == "near_dedup":
            assert set(texts) == {d for d, (_, c) in brute_components(before).items() if d == c}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in texts.items()}


# --- odd columns, long turns, many spans


TURNS = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def said(text, **more):
    return {"kind": "text", "text": text, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | more


@pytest.mark.parametrize("column", ["'x'", "cast(null as int)", "7"])
def test_turns_take_no_ordinal_from_a_column_that_is_not_named(spark, column):
    turns = spark.createDataFrame([(1, 0, "user", [said("a"), said(None, kind="image", ref="r", width=28, height=28)]), (1, 1, "user", [said(None, kind="image")])], TURNS)
    plain, column = rows(chat.format_turns(turns)), F.expr(column)
    clash = turns.withColumns({"first": column, "formatted": column, "n_tokens": column, "ordinal": column})
    assert rows(chat.format_turns(clash)) == plain and "<|image:7|>" not in str(plain)
    numbered = chat.format_turns(chat.number_attachments(clash, "nth"), "nth")
    assert [r.formatted[-20:] for r in numbered.orderBy("turn").collect()] == ["<|image:0|><|im_end|>\n"[-20:], "<|image:1|><|im_end|>\n"[-20:]]
    assert rows(chat.format_turns(turns.withColumn("k", F.lit(None).cast("int")), "k")) == plain


def test_very_long_repeated_and_no_turns(spark):
    long = "é|\\ " * 400_000
    turns = spark.createDataFrame([(1, 0, "assistant", [said(long)])] + [(1, 1, "user", [said("hi")])] * 500 + [(None, 0, None, None)], TURNS)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert (got[1].n_turns, got[1].loss_chars) == (501, len(long)) and got[None].n_turns == 1
    assert got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_spans_taken_apart_equal_a_plain_loop():
    draw = random.Random(9)
    for _ in range(300):
        given = [(s, s + draw.randint(1, 6), draw.randint(0, 5)) for s in (draw.randint(0, 60) for _ in range(draw.randint(0, 40)))]
        chosen = []
        for s, e, k in given:
            if all(e <= c[1] or s >= c[2] for c in chosen):
                chosen.append((k, s, e))
        assert pii.apart(given) == sorted(chosen, key=lambda c: c[1])


def test_many_spans_in_one_text_are_taken_quickly():
    import time

    given = [(7 * i, 7 * i + 5, 4) for i in range(40_000)]
    random.Random(1).shuffle(given)
    began = time.perf_counter()
    assert len(pii.apart(given)) == len(given)
    assert time.perf_counter() - began < 10  # each with all others would be 800 million comparisons


def test_arrow_limits_are_only_lowered(spark):
    from lodestone.llm.common import small_batches

    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "7")
        spark.conf.set(keys[1], "1000000")
        small_batches(spark)
        assert [spark.conf.get(k) for k in keys] == ["7", "1000000"]
        for k in keys:
            spark.conf.unset(k)
        small_batches(spark)
        assert [spark.conf.get(k) for k in keys] == ["1000", "16000000"]
        sizes = spark.range(64).repartition(1).withColumn("t", F.repeat(F.lit("x"), 1_000_000)).mapInArrow(lambda bs: (b.select(["id"]).slice(0, 1) for b in bs), "id long").count()
        assert sizes >= 3  # 64 MB come in several batches
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
