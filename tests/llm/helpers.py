"""Small tables with every awkward row, and brute-force parts."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYLLABLES = "ba de fi go lu ma ne pi ro su ta ve wi zo chi lan mer".split()


def words(rng, n):
    return ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng, n_lines=3, per_line=12):
    return "\n".join(" ".join(words(rng, per_line)).capitalize() + "." for _ in range(n_lines))


def changed(rng, text, n):
    """The text with n words exchanged."""
    parts = text.split(" ")
    for i in rng.sample(range(len(parts)), min(n, len(parts))):
        parts[i] = words(rng, 1)[0]
    return " ".join(parts)


def texts(seed=1, n=60):
    """Prose, exact and near copies, nulls, empties, blanks, one very long text, ties and repeats."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(1, 6), rng.randint(3, 25)) for _ in range(n)]
    out += out[:5]
    out += [changed(rng, out[5], 2) for _ in range(8)] + [changed(rng, out[6], 1) for _ in range(4)]
    out += [f"{out[7]}\n{out[8]}", out[9].upper(), "Aa " * 300, "é ß ñ x\t\x0b y", "one", "one two", ""]
    out += [None, "", " \n\t ", prose(rng, 400, 20)]
    return out


def rows(seed=1, n=60):
    found = [(i, t, ["en", "fr", None][i % 3], [None, "b", "a", "ü"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts(seed, n))]
    found.append((None, "a row without an id but with enough words to be a document of its own", "en", "a", 7))
    return [*found, found[3]]  # a repeated row


def documents(spark, seed=1, n=60):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
