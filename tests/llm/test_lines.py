"""Repeated line runs of any smallest length against brute force."""

import random

import pytest

from merchantscope.llm import lines


def later_lines(texts, min_words):
    """(lines, deleted lines, runs) of each text: all windows of enough words that start at an earlier place too."""
    seqs = {i: [x.strip(" \t\n\r\x0b\x0c") for x in (t or "").split("\n")] for i, t in texts.items()}
    seqs = {i: [x for x in s if x] for i, s in seqs.items()}
    seen, gone = set(), {i: set() for i in seqs}
    for i in sorted(seqs):
        s = seqs[i]
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(len(x.split()) for x in s[a:b]) >= min_words:
                    if tuple(s[a:b]) in seen:
                        gone[i].update(range(a, b))
                    seen.add(tuple(s[a:b]))
    return {i: (len(s), len(gone[i]), sum(k in gone[i] and k - 1 not in gone[i] for k in range(len(s)))) for i, s in seqs.items()}


@pytest.mark.parametrize("min_words", [1, 6])
def test_smallest_runs(docs_of, min_words):
    """A hot line in every text, periodic texts, runs that cross, blank lines; one word is enough where asked for."""
    rng = random.Random(5)
    stock = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 4))) for _ in range(25)]
    texts = {i: "\n".join(["hot", *(rng.choice(stock) + " " * (k % 2) for k in range(rng.randint(0, 14))), " "]) for i in range(40)}
    texts |= {50: "\n".join(["x y"] * 30), 51: "\n".join(["x y"] * 31), 52: None, 53: "", 54: "one\n\none\nhot", -7: "hot\n" + stock[0]}
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs) for r in lines.line_dedup(docs_of(list(texts.items())), min_words).collect()}
    assert got == later_lines(texts, min_words)
