import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that operators use inside, as columns of the input.
CLASHES = ("id", "node", "n", "_row", "row", "kept", "language", "copies", "sequence_id", "cell", "a", "b", "key",
           "component", "found", "_size", "_source", "_held", "digest", "l", "s", "dotted.name")

EN = "the of and to in a is that for it was on with as be by at from this are".split()
DE = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split()


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rng, n, base=EN, common=0.5):
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(40)]
    return " ".join(rng.choice(base) if rng.random() < common else rng.choice(stems) for _ in range(n))


def make_docs(spark, rows):
    """Documents from (doc_id, text, lang, source), with clashing columns."""
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    return spark.createDataFrame(
        [(i, t, g, s, None if t is None else len(t), *["x"] * len(CLASHES)) for i, t, g, s in rows], schema)


def odd_rows():
    """NULLs in every column, empty and very long texts, repeated rows, odd characters."""
    rng = random.Random(3)
    long = prose(rng, 60_000)
    same = prose(rng, 120)
    return [
        (1, None, "en", "a"), (2, "", "de", None), (3, long, "en", "a"), (4, same, "en", "a"), (5, same, None, "b"),
        (None, "text without an id or anything else", None, "b"), (None, "text without an id or anything else", None, "b"),
        (7, "once", "en", "a"), (7, "once", "en", "a"), (8, "Ünïcode ß <|endoftext|> \x00 \u2028 中文 ÉÀ it's", "xx", ""),
        (9, " \t\n", "en", "c"), (10, prose(rng, 300, DE), "de", "c"), (11, same + " and a tail", "en", "a"),
        (None, None, None, None), (12, "!!! ??? 123 456", "fr", "a")]
