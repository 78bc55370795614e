"""The near-duplicate stage on texts of one word set, edits and chains, against all pairs."""

import random

from corpusmill.llm import golay_simhash

WORDS = [f"w{i}" for i in range(4000)]


def five(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in golay_simhash.drop_similar(df).collect()}


def classes(texts):
    """Smallest member of each class of the graph of pairs that are alike."""
    sets, own = [five(t) for t in texts], list(range(len(texts)))
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, j in sorted(alike):
        a, b = sorted((root(i), root(j)))
        own[b] = a
    return {root(i) for i in range(len(texts))}, alike


def test_texts_alike_to_each_other_but_not_to_the_first_of_their_words(spark):
    words = WORDS[:120]
    other, swapped = random.Random(1).sample(words, 120), words[:]
    swapped[10], swapped[11] = swapped[11], swapped[10]
    texts = ["unlike all others here", " ".join(other), " ".join(words), " ".join(words), " ".join(swapped)]
    assert kept(spark, texts) == {0, 1, 2}


def test_orders_of_one_word_set_edits_and_chains_against_all_pairs(spark):
    rng, texts = random.Random(3), []
    for group in range(12):
        words = rng.sample(WORDS, 150)
        for order in range(6):
            base = rng.sample(words, 150)
            texts.append(" ".join(base))
            for step in range(4):
                # Each text differs from the one before by two words: chains whose ends are less alike than 0.8.
                base = base[:]
                for _ in range(2):
                    at = rng.randrange(150)
                    if step % 2:
                        base[at] = rng.choice(WORDS)
                    else:
                        base[at], base[at - 1] = base[at - 1], base[at]
                texts.append(" ".join(base))
    rng.shuffle(texts)
    whole, alike = classes(texts)
    got = kept(spark, texts)
    assert len(alike) > 250 and whole <= got
    assert len(got - whole) <= 0.02 * (len(texts) - len(whole))


def test_templates_of_which_no_two_are_alike_stay(spark):
    rng = random.Random(5)
    frame = WORDS[:60]
    texts = [" ".join(frame + rng.sample(WORDS[100:400], 60)) for _ in range(60)]
    assert kept(spark, texts) == classes(texts)[0]


def test_texts_of_one_frame_in_unlike_orders_make_no_pair_each(spark, monkeypatch):
    """All have one word set and so share bands; the rows to verify grow with their number, not its square."""
    rng, words, texts = random.Random(7), WORDS[:100], []
    for _ in range(200):
        end = words[75:]
        rng.shuffle(end)
        texts.append(" ".join(words[:75] + end))
    asked, verified = [], golay_simhash._verified
    monkeypatch.setattr(golay_simhash, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    assert kept(spark, texts) == classes(texts)[0]
    assert sum(asked) <= 2 * len(texts)


def test_classes_of_a_group_that_is_dealt_in_blocks_against_all_pairs(spark):
    rng, rows = random.Random(11), []
    for i in range(90):
        base = i // 2 % 12
        rows.append((i, 100 + i // 2, sorted({*range(base * 1000, base * 1000 + 40)} - set(rng.sample(range(base * 1000, base * 1000 + 40), rng.randrange(8)))) + [10**6 + i]))
    names = {node: cls for node, cls, _ in rows}
    links = {(names[a], names[b]) for a, _, x in rows for b, _, y in rows if a != b and jaccard(set(x), set(y)) >= 0.8}

    def parts(links):
        own = {c: c for c in names.values()}
        for a, b in links:
            low, high = sorted((own[a], own[b]))
            own = {c: low if o == high else o for c, o in own.items()}
        return own

    sets = spark.createDataFrame([(n, bytearray(golay_simhash.np.array(v, "u8").tobytes())) for n, _, v in rows], "node long, set binary")
    keys = spark.createDataFrame([(n, 0, b, 5, 8 * len(v), c) for n, c, v in rows for b in range(2)], "node long, cell long, band int, key long, bytes long, settled long")
    for group_bytes in (1 << 24, 4000):
        found = golay_simhash.class_links(keys, sets, 0.8, group_bytes).collect()
        assert parts((r["src"], r["dst"]) for r in found) == parts(links) and len(set(parts(links).values())) > 1
