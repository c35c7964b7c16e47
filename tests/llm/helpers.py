"""Plain versions of what the operators compute, and documents with all kinds of edges."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")

TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
#: Nulls, empty and blank texts, repeated rows and ids, ties, a very long text, non-ASCII letters, odd white space.
EDGES = [
    (1, TEXT, "en", "a", 1),
    (2, TEXT.upper(), "en", "a", 1),
    (3, TEXT.replace("mu", "MEW"), None, "b", 1),
    (4, None, None, None, None),
    (5, "", "en", "a", 0),
    (6, " \t\n \n", "en", "b", 4),
    (7, "one two", "en", None, 7),
    (7, "one two", "en", None, 7),
    (8, "one two", "en", "c", 7),
    (8, "other words under the same name here", "en", "c", 7),
    (None, TEXT, "en", "c", 7),
    (9, "Ünïcode größer façade  two  spaces　wide\n\n<|endoftext|> it's", "de", "c", 9),
    (10, " ".join(f"w{i % 977}x{i}" for i in range(30_000)), "en", "a", 1),
    (11, "\n".join([TEXT] * 40), "en", "a", 1),
    (12, TEXT + " \n" + TEXT.replace("pi", "pie"), "en", "a", 1),
]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=EDGES):
    """As a table that also has columns named like the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.withColumns({c: F.lit("clash") for c in ("size", "row", "row_id", "cls", "score", "item", "tie", "ord", "gone", "bucket")})


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def shingles(text, width=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def groups(sets, percent=75):
    """For each set, the first index that links reach."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and both * 100 >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def near_lines(rows, near_words=3):
    """(doc_id, line number) of the lines that line dedup takes, row by row in order."""
    seen, swapped, left = set(), set(), set()
    out = []
    for doc_id, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            norm = re.sub(r"[\x20\x09-\x0D]+", " ", line).lower().strip(" ")
            words = norm.split(" ") if norm else []
            if not words:
                continue
            drop = [tuple(words[:i] + words[i + 1 :]) for i in range(len(words))]
            near = len(words) >= near_words and (any((i, v) in swapped for i, v in enumerate(drop)) or any(" ".join(v) in seen for v in drop) or tuple(words) in left)
            if norm in seen or near:
                out.append((doc_id, k))
            seen.add(norm)
            swapped.update(enumerate(drop))
            left.update(drop)
    return out
