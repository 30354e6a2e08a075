"""Small fixtures and brute force for the tests of this folder."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, first=0):
    """Documents with ids from ``first`` on; every third one has the hot source."""
    rows = [(first + i, t, "en", "src0" if i % 3 == 0 else f"src{i % 5}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed, size=400):
    rng = random.Random(seed)
    return " ".join("w" + format(rng.randrange(size), "x") for _ in range(n))


def edited(text, seed, edits):
    rng, parts = random.Random(seed), text.split(" ")
    for _ in range(edits):
        parts[rng.randrange(len(parts))] = f"x{rng.randrange(10**6)}"
    return " ".join(parts)


def corpus():
    """Plain texts, copies, near copies, shared passages, empty, null and very long texts."""
    base = [words(60 + 5 * i, i) for i in range(12)]
    near = [edited(base[0], s, 1 + s % 4) for s in range(14)]
    passage = words(40, 99)
    shared = [f"{words(20, 200 + i)} {passage} {words(15, 300 + i)}" for i in range(6)]
    odd = ["", None, " ", "one", "One", "two words", "Two  words\n", "ä Ö ß 中文 \U0001f600 é", "x" * 4000, words(6000, 7), "\x1c\x0b\t a  b c <|endoftext|> it's"]
    return base + near + shared + odd + base[:4] + [base[1].upper(), passage, passage]


def shingle_set(text, k):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset([tuple(found)] if len(found) < k else zip(*(found[i:] for i in range(k)), strict=False))


def brute_components(docs, k, percent):
    """``{id: smallest id reachable}`` over all pairs."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common) and common:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
