import random

import pytest

SCHEMA = "doc_id long, text string, id long, th long, fp long, score double, spans string"


def sample_texts() -> list[str | None]:
    """Texts with everything that has gone wrong somewhere: empty, blank, copies, long words, other scripts, repeats."""
    rng = random.Random(11)
    syllables = ["tha", "ing", "er", "on", "st", "re", "ou", "ç", "ñez", "ß", "wh", "le"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    passage, line = prose(70), "A Line That Many Share."
    texts: list[str | None] = [None, "", " ", "\n", "\n\n", "a", "a b", "  two  spaces  ", "tab\there\r\nthere ", "x" * 3000, "ab" * 400, "中文字" * 200, "🙂 <s> <|endoftext|> </s> it's we'll ▁▁x"]
    texts += [prose(rng.randint(3, 120)) for _ in range(12)]
    texts += [f"{prose(20)}\n{passage}\n{prose(10)}" for _ in range(4)]
    texts += [f"{line}\n{prose(15)}\n{line.upper()}  \n{prose(5)}" for _ in range(3)]
    near = prose(150)
    texts += [near, near, near.replace("tha", "tha ", 1), near + " end", near[:-4]]
    texts += ["\n".join([prose(6)] * 9), " ".join([word()] * 200), "#$% " * 40 + prose(30), prose(4000)]
    return texts


@pytest.fixture(scope="session")
def texts():
    return sample_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The sample under ids 0, 3, 6, ...; then a null id, a repeated row, and an id that is repeated with another text."""
    rows = [(3 * i, t, 1, 2, 3, 0.5, "x") for i, t in enumerate(texts)]
    rows += [(None, texts[14], 1, 2, 3, 0.5, None), rows[15], (rows[16][0], "another text", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def rows(docs):
    """(doc_id, text) of the sample."""
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table_of(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)
