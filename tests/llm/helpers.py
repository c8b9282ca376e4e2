"""Small tables with odd rows, and plain versions of what the operators compute."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `key` int, id string, `a.b` double, kept boolean"


def sentence(draw, n):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6))) for _ in range(n))


def odd_rows(seed=1):
    """Nulls in every column, empty and long texts, equal texts under several ids, repeated rows and repeated ids."""
    draw = random.Random(seed)
    texts = [None, "", " ", "\n\t", "one", "one two three", "a  b", "a b", " a b", "x" * 20_000, "Å é 漢字 😀 ok", sentence(draw, 4000)]
    base = sentence(draw, 120)
    near = base.split()
    for k in (3, 40, 80):
        near[k] = "changed"
    texts += [base, base.upper(), base.replace(" ", "\n"), " ".join(near), base + " tail", sentence(draw, 60), sentence(draw, 60)]
    rows = []
    for k, text in enumerate(texts * 3):
        rows.append((k * 7 % 61, text, ["en", None, "de"][k % 3], ["s1", "s2", None, ""][k % 4], None if k % 5 == 0 else k, "r", 1, "i", 0.5, True))
    rows += [rows[3], rows[3], rows[20], (None, base, "en", "s1", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


def odd_docs(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, k):
    words = WORDS.findall(lowered(text))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_components(rows, k, percent=80):
    """{id: smallest id reachable}; rows are (id, text)."""
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both) and top(i) != top(j):
                low, high = sorted((top(i), top(j)))
                up[high] = low
    return {i: top(i) for i in up}
