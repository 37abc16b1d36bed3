"""Word hashes, and near-duplicates against all pairs, on texts made to meet."""

import random

import numpy as np

from phrasegraph.llm import minhash
from phrasegraph.llm.common import utf8_bytes
from phrasegraph.llm.shingles import word_bounds, word_hashes


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_patterned_words_stay_apart(spark):
    """Two words of 1,024 bytes that any polynomial modulo 2^64 with an odd base gives one hash."""
    import pyarrow as pa

    words = [thue_morse(n, letters) for n in (64, 1024, 4096) for letters in ("ab", "ba")]
    data, offsets = utf8_bytes(pa.array(words + ["AB" * 5, "ab" * 5]))
    starts, ends, _ = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    assert len(np.unique(hashes[:6])) == 6 and hashes[6] == hashes[7]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert all(r.kept for r in minhash.near_duplicates(docs, size=3, percent=85).collect())


def test_links_between_edited_copies(spark):
    """Edited copies of one text, many not linked with the text that leads their bucket."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.choice([1, 6, 12])):
            text[rng.randrange(300)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(text)))
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(298)} for i, t in rows}
    label = list(range(120))
    links = 0
    for i in range(120):
        for j in range(i + 1, 120):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                links += 1
                a, b = label[i], label[j]
                label = [min(a, b) if c in (a, b) else c for c in label]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, size=3, percent=85).collect()}
    assert links and got == dict(enumerate(label))
