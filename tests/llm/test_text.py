"""Text operators against brute force, round trips, held-out accuracy and hard rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
import tiktoken
from tickloom.llm import bpe, chat, decontam, hilbert, langid, lines, minhash, pii, quality, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words string, component_id string"


def hard(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 9000} and" for i in range(60000))
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t", "en", "s"), (4, long, "en", "s"), (5, "same text of the two rows here\nand a line", "en", None), (5, "same text of the two rows here\nand a line", "en", None),
            (6, "same text of the two rows here\nand a line", "de", "t"), (None, "a row that has no id but a mail me@site.org", None, "t"), (None, None, None, None), (7, "x" * 300000, "fr", "s"), (8, "12 !? 34", "fr", "s")]
    return spark.createDataFrame([(*r, 1, True, "n", "c") for r in rows], SCHEMA)


def all_ways(docs, spark):
    bench = spark.createDataFrame([(1, "the two rows here and a line of the text"), (2, None), (None, "")], "item_id long, text string")
    return {
        "pii": pii.pseudonymised(docs, "k"), "quality": quality.classify(docs), "decontam": decontam.contamination(docs, bench), "shards": hilbert.shard_rows(docs),
        "lang": langid.predict(docs, langid.fit(docs)), "near": minhash.near_duplicates(docs), "lines": lines.line_quality(docs), "cut": lines.without_frequent_lines(docs), "bpe": bpe.encoded(docs, with_ids=True),
    }


def test_hard_rows_keep_every_row(spark):
    docs = hard(spark)
    n = docs.count()
    got = {k: v.collect() for k, v in all_ways(docs, spark).items()}
    assert {k: len(v) for k, v in got.items()} == {k: n for k in got}
    assert [r._lang.lang_pred for r in got["lang"] if r.text is None or not any(c.isalpha() for c in r.text)] == ["und"] * 5
    assert {(r.doc_id, r.component_id) for r in got["near"] if r.doc_id in (5, 6)} == {(5, 5), (6, 5)}
    assert all(r.kept for r in got["near"] if r.doc_id is None)
    assert all(r._bpe.n_tokens == 0 for r in got["bpe"] if not r.text)
    assert not any(r._quality.kept for r in got["quality"] if not (r.text or "").strip())
    mails = [r.text for r in got["pii"] if r._n_entities]
    assert len(mails) == 1 and "me@site.org" not in mails[0] and mails[0].endswith(".org")
    assert [r.text for r in got["pii"] if r.doc_id == 1] == [None]


def test_empty_tables(spark):
    docs = hard(spark).limit(0)
    assert {v.count() for v in all_ways(docs, spark).values()} == {0}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_preferences(chat.preference_pairs(chat.conversations_as_arrays(turns))).count() == 0


def test_pipeline_on_hard_rows_and_small_table(spark):
    docs = hard(spark)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        assert name == "byte_bpe" or after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
    out = corpus_pipeline.run(spark, SF)
    ids = [r.doc_id for r in out.collect()]
    assert 50 < len(ids) == len(set(ids)) < 200


def test_bpe_is_tiktoken_and_round_trips():
    data = open(public_tokenizers.path(bpe.VOCABULARY), "rb").read()
    ranks = bpe.read_ranks(data)
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    pools = ["abcdefghij  \n\t'", "éèçñüß ÀÉ", "中文字 日本語", "0123456789 .,!?-", "🙂👍​  \x1c\x85 x", "aaaa bb", "शब्द اللغة"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(120))) for _ in range(1500)] + ["", "a" * 5000, "ab" * 3000, " " * 999 + "x", "don't we'll I'M"]
    rows = bpe.Encoder(data, public_tokenizers.PATTERN).encode(texts, True)
    for t, (n, _, _, ids) in zip(texts, rows, strict=True):
        assert ids == real.encode_ordinary(t) and n == len(ids)
        assert bpe.decode(ids, ranks) == t.encode()


def test_replay_defers_a_word_when_a_merge_opens_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 300, b"abcab": 258}
    def one(word):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = [bytes(w) for n in range(1, 8) for w in itertools.product(b"abc", repeat=n)]
    words = [w for w in words if w not in ranks]
    assert bpe.Replay(ranks).encode(words) == [one(w) for w in words]


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        diag, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            diag, row[j] = row[j], min(diag + (p != c), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    items = [" ".join(word() for _ in range(18)) for _ in range(12)]
    docs = []
    for i in range(80):
        text = " ".join(word() for _ in range(60))
        if i % 2:
            t = list(items[i % 12])
            for _ in range(rng.randrange(0, 10)):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], ["x"], [t[at], "y"]])
            text = text[:100] + " " + "".join(t).upper() + "!!\n" + text[100:]
        docs.append((i, text))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("norm", decontam.normal(F.col("text")))
    for block in (5, 20000):
        for r in decontam.contamination(frame, bench, block).collect():
            want = sorted((k, d) for k, t in enumerate(items) if (d := edit_distance_in(t, r.norm)) <= len(t) // decontam.CHARS_PER_EDIT)
            assert [(f.item_id, f.distance) for f in r._found] == want


def test_items_that_repeat_their_own_pieces_against_brute_force():
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    x, y, z = "what is the val", "ue of number on", "e of this table"
    cases = [(x + y + x + z, "so it goes " * 3 + x[:7] + "q" + x[8:] + y[:7] + "q" + y[8:] + x + z + " and more")]
    for _ in range(1500):
        parts = [letters(15) for _ in range(2)]
        item = "".join(rng.choice(parts) for _ in range(rng.randrange(3, 7)))
        t = list(item)
        for _ in range(rng.randrange(0, len(item) // 20 + 2)):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[], ["x"], [t[at], "y"]])
        cases.append((item, letters(rng.randrange(0, 60)) + rng.choice(["", parts[0]]) + "".join(t) + letters(30)))
    for item, text in cases:
        d = edit_distance_in(item, text)
        want = [(7, d)] if d <= len(item) // decontam.CHARS_PER_EDIT else []
        assert [f[:2] for f in decontam.Items([(7, item)]).search(text)] == want


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("ab") + str(rng.randrange(400))
    docs, base = [], [word() for _ in range(60)]
    for i in range(160):
        t = list(base) if i < 110 else [word() for _ in range(rng.randrange(1, 40))]
        for _ in range(rng.randrange(0, 7) if i < 110 else 0):
            t[rng.randrange(len(t))] = word()
        docs.append((i, " ".join(t)))
    docs += [(500 + i, docs[i][1].upper()) for i in range(0, 160, 7)]
    sets = {d: frozenset(tuple(t.lower().split()[j : j + 3]) for j in range(max(1, len(t.split()) - 2))) for d, t in docs}
    root = {d: d for d in sets}
    for _ in range(20):
        for a, b in itertools.combinations(sets, 2):
            if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(s) for d, s in sets.items()}


def test_pipeline_judges_copies_by_row(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, text("a"), "x"), (2, text("a") + " more", "x"), (2, text("b"), "x"), (3, text("c"), "z"), (3, text("c"), "y"),
            (None, text("d"), "x"), (None, text("d"), "w"), (None, text("a"), "x"), (None, text("e"), "x"), (4, text("f"), "x"), (4, text("g"), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for frame in (docs, docs.repartition(3, "source")):
        got = corpus_pipeline.near_duplicates(spark, frame, SF)
        assert got.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text[0], r.source) for r in got.collect()) == [(0, "d", "w"), (0, "e", "x"), (1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "f", "x"), (4, "g", "x")]


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    text = " ".join(f"w{i}é" for i in range(5000))
    whole = minhash.shingle_hashes(text, 3)
    monkeypatch.setattr(minhash, "CHUNK", 777)
    assert np.array_equal(minhash.shingle_hashes(text, 3), whole)


def test_surrogates_are_distinct_alike_and_the_same_everywhere(spark):
    texts = ["Mrs. Anna Smith met Mr. John Smith. Frau Müller, mail Anna.S@mail.example.com or call +1 (499) 555-6503",
             "mr. nobody. Mr. Smith pays 4087441028983991 from 10.1.2.3, key = \"1eb9c654e721b4f812088970e66a6345\"",
             "call +1 499 555 6503 or anna.s@MAIL.example.com; господин Иванов 4087 4410 2898 3991; order 1234567890123456"]
    many = [f"ip 9.{i // 250}.{i % 250}.7" for i in range(600)]
    frame = spark.createDataFrame(list(enumerate(texts + many)), "doc_id long, text string")
    got = [r.text for r in pii.pseudonymised(frame, "k").orderBy("doc_id").collect()]
    assert got == [r.text for r in pii.pseudonymised(frame.repartition(5), "k").orderBy("doc_id").collect()]
    assert got != [r.text for r in pii.pseudonymised(frame, "other").orderBy("doc_id").collect()]
    family = got[0].split()[2]
    assert got[0].split()[6].rstrip(".") == family and f"Mr. {family} pays" in got[1]
    assert got[0].split()[1].lower() in [n.lower() for n in pii.GIVEN["latin"]["f"]] and got[0].split()[5].lower() in [n.lower() for n in pii.GIVEN["latin"]["m"]]
    assert "".join(filter(str.isdigit, got[0])) == "".join(filter(str.isdigit, got[2].split(";")[0])) != "14995556503"
    card = "".join(filter(str.isdigit, got[2].split(";")[1]))
    assert card in got[1] and card[0] == "4" and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(card[::-1])) % 10 == 0
    assert "order 1234567890123456" in got[2] and "Иванов" not in got[2]
    ips = [t[3:] for t in got[3:]]
    assert len(set(ips)) == 600 and not set(ips) & {m[3:] for m in many}


def test_collisions_are_drawn_again(spark, tmp_path):
    from tickloom.llm.common import Scratch

    names = spark.range(3000).select(F.lit("given_m").alias("kind"), F.concat(F.lit("name"), F.col("id").cast("string")).alias("value"))
    got = pii.surrogates(names, "k", Scratch(spark, "t")).collect()
    assert len(got) == len({r.surrogate for r in got}) == len({r.value for r in got}) == 3000


def test_short_mailboxes_grow_when_their_domain_is_used_up(spark):
    from tickloom.llm.common import Scratch

    boxes = spark.createDataFrame([("email", f"{c}@x.org") for c in "abcdefghijklmnopqrstuvwxyzéèüöä"], "kind string, value string")
    got = [r.surrogate for r in pii.surrogates(boxes, "k", Scratch(spark, "t")).collect()]
    assert len(got) == len(set(got)) == 31 and all(g.count("@") == 1 and g.endswith(".org") for g in got)


def test_hilbert_curve_and_shards(spark):
    axes = np.array(list(itertools.product(range(8), repeat=3)))
    order = axes[np.argsort(hilbert.curve_index(axes, 3))]
    assert sorted(hilbert.curve_index(axes, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    got = hilbert.shard_rows(spark.read.parquet(f"{SF}/documents.parquet"), per_bucket=10).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    ranges = hilbert.manifest(spark.createDataFrame(got.drop(columns="grown_shard"))).toPandas()
    assert (ranges.max_lang_rank - ranges.min_lang_rank).mean() < (got.lang_rank.max() - got.lang_rank.min())


def test_language_on_held_out_rows(spark):
    from tickloom.llm.queries import op7

    got = op7(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.98
    text = "élan vital " * 50
    assert (langid.grams(text) == langid.grams(text)).all() and langid.grams(None).sum() == 0


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality.classify(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("_quality.kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in got.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_labellers_look_at_the_whole_text():
    votes = lambda t, lang=None: dict(zip(quality.LABELLERS, quality.votes_of(quality.looked_at(t, lang)[0]), strict=True))
    junk = "the of and to in " + " ".join(f"blob{i}" for i in range(500))
    assert votes(junk)["stop"] == 0 and votes(junk, "en-US")["stop"] == 0 and votes("the cat of the house is in a box " * 30, "en")["stop"] == 1
    assert votes("żaden pies nie lubi kota " * 5, "pl")["stop"] == votes("собака живёт дома " * 9)["stop"] == -1
    assert votes("a1 2 3 4 (5) -- b")["letters"] == 0 and votes("plain words of letters here")["letters"] == 1
    assert votes("don't l'eau well-known mother-in-law शब्द हिन्दी है")["marks"] == 1 and votes("the*** cat!! is")["marks"] == 0
    assert votes("\n\n".join(f"paragraph {i} of the text" for i in range(8)))["lines"] == 1 and votes("same line\n" * 9)["lines"] == 0
    slots = [set(quality.features(quality.looked_at(t, "en"))[0]) for t in ("alpha beta", "gamma delta")]
    assert slots[0] != slots[1] and quality.HASHED == 4096


def test_url_rules(spark):
    rows = [(1, "http://A.Example.NET/en/x?q"), (2, "https://net/"), (3, "http://a.net"), (4, None), (5, "nothing"), (6, "http://x.org/fr/a#b"), (7, "http://x.org/zz/SPAM9"), (8, "http://b.example.com/de/"), (8, "http://b.example.com/de/"), (9, "http://my-casino-x.org/")]
    rules = urls.rule_table(spark, patterns=[("SPAM*", "block"), ("^casino-*", "block")])
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect())
    assert got == [(1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "net", "/", "net/", "block"), (3, "a.net", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
                   (6, "x.org", "/fr/a", "org/fr/", "allow"), (7, "x.org", "/zz/SPAM9", None, "block"), (8, "b.example.com", "/de/", "example.com/de/", "block"), (8, "b.example.com", "/de/", "example.com/de/", "block"), (9, "my-casino-x.org", "/", None, "block")]
    tokens = spark.createDataFrame([("example",), ("example",), ("net",)], "token string")
    index = {r.rule: r.token for r in urls.token_index(tokens, urls.compiled(rules)).collect()}
    assert index["example.net/en/"] == "en" and index["SPAM*"] == "" and index["^casino-*"] == "casino"


def test_preferences(spark):
    turns = [(2, 0, "user", "hi"), (2, 1, "assistant", "yes <|end|>"), (2, 2, "user", None), (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (4, 0, "user", "hi"), (None, 0, "user", "hi"), (6, 0, None, "é"), (7, 0, None, "é")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r.chosen_id, r.rejected_id): r for r in chat.format_preferences(chat.preference_pairs(chat.conversations_as_arrays(frame))).collect()}
    assert {k: (r.prompt_turns, r.status) for k, r in got.items()} == {(2, 3): (1, "pair"), (2, 4): (1, "prefix"), (6, 7): (1, "identical")}
    r = got[2, 3]
    a, b = map(int, r.chosen_loss.split("-"))
    assert r.prompt == "<|user|>\nhi<|end|>\n" and r.chosen_text[a:b] == "yes < |end|><|end|>" and r.rejected_loss == "14-23"


@pytest.mark.parametrize("n", [5, 30])
def test_frequent_lines(spark, n):
    rows = [(i, f"own line number {i} of words that differ w{i}a w{i}b w{i}c\nShared, line! of the host here", "h") for i in range(n)] + [(99, "shared line of the host here\n" * 3 + "a b", "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: (r.words_left, r.kept) for r in lines.line_quality(frame).collect()}
    assert kept[0] == ((11, True) if n > 20 else (17, True)) and kept[99][0] == (2 if n > 20 else 20)
    cut = {r.doc_id: r.text for r in lines.without_frequent_lines(frame).collect()}
    assert ("Shared" in cut[0]) == (n <= 20)


def test_known_words_are_not_walked_by_the_collector():
    """A worker remembers up to 200,000 words: nothing of them may cost each collection."""
    import gc

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        e = bpe.Encoder(f.read(), public_tokenizers.PATTERN)
    rows = e.encode(["zqxvk zqxvk blorptangle", "", "h"], True)
    assert [len(r[3]) for r in rows] == [r[0] for r in rows] and b"".join(e.replay.token[i] for i in rows[0][3]) == b"zqxvk zqxvk blorptangle"
    gc.collect()
    assert e.known and not any(gc.is_tracked(v) for v in e.known.values())


def test_bpe_workers_remember_little(monkeypatch):
    """Pairs and words stay below their bounds between blocks of texts, with the same ids; ids are small arrays, not lists."""
    monkeypatch.setattr(bpe, "PAIRS", 300)
    monkeypatch.setattr(bpe, "REMEMBER", 500)
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        data = f.read()
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(data), special_tokens={})
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(3)) for _ in range(1024)]
    e = bpe.Encoder(data, public_tokenizers.PATTERN)
    rows = e.rows(texts, True)
    assert len(e.replay.pairs) <= 300 and len(e.known) <= 500 + 256 * 3
    assert all(r[3].itemsize == 4 and r[3].tolist() == real.encode_ordinary(t) for r, t in zip(rows, texts, strict=True))


def test_bpe_replays_short_words_in_rounds(monkeypatch):
    """Words of 64 bytes at most never go through the index, longer ones do; both give tiktoken's ids."""
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    real = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdeinrst éß中🙂", k=n)) for n in [*range(1, 70)] * 4] + ["a" * 63, "a" * 64, "a" * 65, "é" * 32, "é" * 33]
    replay, seen = bpe.Replay(ranks), []
    indexed = replay._indexed
    monkeypatch.setattr(replay, "_indexed", lambda words: seen.extend(words) or indexed(words))
    assert replay.encode([t.encode() for t in texts]) == [real.encode_ordinary(t) for t in texts]
    assert {len(w) > 64 for w in seen} == {True} and replay.encode([]) == []


def test_workers_give_memory_back(spark):
    """What a BPE worker remembers ends with its task; powers of a usual text are small; tables are stored from small batches."""
    from tickloom.llm import common

    word = minhash.word_hashes("a bc " * 9)
    assert all(p.nbytes < 2 << 20 for p in minhash._powers(minhash.USUAL + 2))
    assert (minhash.word_hashes("a bc " * 40_000)[:18] == word).all()

    class Told:
        write = property(lambda self: self)
        schema = "n long"

        def parquet(self, path):
            self.seen = [spark.conf.get(k) for k in common.BATCHES]
            spark.range(1).toDF("n").write.parquet(path)

    before, told = [spark.conf.get(k) for k in common.BATCHES], Told()
    common.Scratch(spark, "batches").put(told, "t")
    assert all(int(x) <= common.BATCH for x in told.seen) and before == [spark.conf.get(k) for k in common.BATCHES]

    @F.udf("long")
    def remembered(n):
        return sum(len(e.known) for e in bpe._ENCODERS.values())

    docs = spark.createDataFrame([(i, f"zqxvk{i} blorp") for i in range(40)], "doc_id long, text string").repartition(1)
    assert bpe.encoded(docs).where("_bpe.n_tokens > 0").count() == 40
    assert {r[0] for r in docs.select(remembered("doc_id")).collect()} == {0}
