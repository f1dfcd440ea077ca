"""Documents with every odd case, and small corpora with planted copies."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size long, t string, copies int, body string, bucket int, row string, doc int, a int, kept boolean, `with.dot` int"

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))


def edge_rows():
    texts = [
        (0, None, "en", "s1"), (1, "", "en", "s1"), (2, " \t\n\x0b\x0c\r ", "de", None), (3, "one two", None, "s1"), (3, "one two", None, "s1"),
        (None, "a row without an id that is long enough to count as ten words", "en", "s2"), (None, None, None, None), (4, LONG, "en", "s1"), (5, LONG, "en", "s2"),
        (6, "Ünïcödé ñandú 漢字 🙂 #hash * $ % & | < > ünïcödé ñandú", "es", "s2"), (7, "The same line of more than twenty signs\nthe SAME line of more than twenty signs \nend", "en", "s2"),
        (8, "The same line of more than twenty signs", "en", ""), (9, "x\nThe same line of more than twenty signs", "en", "s3"), (10, "tie tie tie tie tie tie tie tie tie tie tie tie", "en", "s3"),
        (11, "tie tie tie tie tie tie tie tie tie tie tie tie", "en", "s3"), (12, "NUL \0 and \x1c and \x85 and \xa0 marks<|endoftext|>end", "fr", "s3"), (-1, "negative id", "fr", "s3"),
    ]
    return [(d, t, lang, src, None, 7, 9, "t", 3, "b", 1, "r", 2, 5, None, 6) for d, t, lang, src in texts]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(n=120, seed=1):
    """(doc_id, text) with exact copies, near copies, shared passages and lines."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line, passage = sentence(8), sentence(60)
    out = []
    for k in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            text = rng.choice(out)[1]
        elif out and kind < 0.4:
            words = rng.choice(out)[1].split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = "\n".join(sentence(rng.randint(3, 40)) for _ in range(rng.randint(1, 6)))
            if rng.random() < 0.4:
                text += "\n" + line
            if rng.random() < 0.3:
                text = text + " " + passage + " " + sentence(5)
        out.append((k, text))
    return out


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 4}") for d, t in rows], "doc_id long, text string, lang string, source string").repartition(3)


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
