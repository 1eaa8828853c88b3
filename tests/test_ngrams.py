"""Repeated runs of two to eight words against a plain count."""

from collections import Counter

from kelpie.operators import text


def test_runs_of_eight_words_are_found(spark):
    texts = ["a b c d e f g h x a b c d e f g h", "a b a b a b", "a b c d e f z a b c d e f z b c y b c", "one two three", ""]
    got = {r.doc_id: tuple(r)[1:] for r in text.repeated_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()}
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        c = [(k, n, " ".join(g)) for n in range(2, 9) for g, k in Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)).items() if k > 1]
        if c:
            most, longest = min((-k, -n, g) for k, n, g in c), min((-n, -k, g) for k, n, g in c)
            want[i] = (most[2], -most[1], -most[0], longest[2], -longest[0], -longest[1])
    assert got == want and got[0][4] == 8
