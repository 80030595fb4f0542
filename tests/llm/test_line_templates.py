"""Which lines count as repetitions of others."""

import os
import random
import sys

import xxhash

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402
from itemloom.llm.line_templates import agree, drop_repeated_lines  # noqa: E402


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return {r.doc_id: r.kept_text for r in drop_repeated_lines(docs).select("row.doc_id", "kept_text").collect()}


def test_documents_keep_their_own_numbers_and_short_lines(spark):
    first = "2019 12.4 8.1 7 6.5 4\n| 3 | 7 |\npage 12\n2021-03-04\nthe price of it is 12\na b c d e\nsame 1 2"
    other = "2020 13.4 9.1 8 7.5 5\n| 4 | 8 |\npage 13\n2022-05-06\nthe price of it is 13\na b c d f\nsame 1 2"
    wide = "of it and in to by on at " + " ".join(map(str, range(20)))
    wider = "of it and in to by on at " + " ".join(map(str, range(20, 40)))
    found = kept(spark, [f"{first}\n{wide}", f"{other}\n{wider}"])
    assert found == {0: f"{first}\n{wide}", 1: f"{other}\n{wider}".replace("\nsame 1 2", "")}


def test_a_template_with_enough_constant_words_is_dropped(spark):
    line = "this work of {} may be copied under the terms of the license {}"
    assert kept(spark, [line.format(2019, "a"), line.format(2020, "b")]) == {0: line.format(2019, "a"), 1: ""}


def test_fields_in_common_are_not_agreement_enough():
    one, two = b"<*> <*> <*> <*> <*> <*> <*> <*> a b".split(), b"<*> <*> <*> <*> <*> <*> <*> <*> a c".split()
    assert not agree(one, two)
    assert agree(b"a b c d e f g h i j".split(), b"a b c d e f g h x y".split())


#: Lines of leaves of their own: with them around, no other leaf of a test has a large share.
FILL = "\n".join(f"fill {chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)} a b c d e f g h" for i in range(8_000))


def chain():
    """Lines a, b, c in the order of their hashes; b agrees with both others, which do not agree."""
    make = random.Random(1)
    while True:
        words = ["same", "three", "words"] + ["".join(make.choices("abcdefgh", k=5)) for _ in range(11)]
        base, other = words[:10], words[10:]
        lines = [base, [*base[:6], *other[:2], *base[8:]], [*base[:6], *other[:2], *other[2:4]]]
        a, b, c = (" ".join(x).encode() for x in lines)
        part = [xxhash.xxh64_intdigest(xxhash.xxh3_128_digest(x), 42) % 16 for x in (a, b, c)]
        if sorted((a, b, c), key=xxhash.xxh3_128_digest) == [a, b, c] and part[0] != part[1] == part[2]:
            return [x.decode() for x in (a, b, c)]


def test_a_leaf_has_the_same_templates_whatever_its_share(spark):
    a, b, c = chain()
    want = {0: a, 1: "", 2: c}
    assert kept(spark, [a, b, c]) == want
    assert kept(spark, [a, b, c, FILL]) == want | {3: FILL}


def test_many_overlapping_templates_in_one_leaf(spark):
    make = random.Random(2)
    texts = [" ".join(["same", "three", "words", *make.choices("ab", k=9)]) for _ in range(300)]
    rows = list(enumerate(texts))
    want = {k: t for k, (_, _, t) in brute.kept_lines(rows).items()}
    assert 0 < sum(not t for t in want.values()) < len(texts)
    assert kept(spark, texts) == want
    assert kept(spark, [*texts, FILL]) == want | {len(texts): FILL}
