import random

CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, f1 int, id int, component int"


def frame(spark, texts, source=lambda i: "s", lang=lambda i: "en"):
    """texts: doc_id -> text, or pairs. Extra columns have the names that operators use inside."""
    rows = texts.items() if isinstance(texts, dict) else texts
    return spark.createDataFrame([(i, t, lang(i), source(i), len(t or ""), 0, 0, 0) for i, t in rows], CLASH)


def prose(rnd: random.Random, n: int, size: int = 5000) -> list[str]:
    return [f"{'bcdfg'[w % 5]}{'aeiou'[w // 5 % 5]}w{w}" for w in (rnd.randrange(size) for _ in range(n))]


def blanks_split(text):
    """Words of a text, as the operators count them."""
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]
