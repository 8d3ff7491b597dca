import random

import pytest

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use inside
    "score double, row long, label long, component_id long, seed long, place long, seeds long, number long, "
    "quality int, toxic int, cell long, base string, spans string, kept boolean"
)
SYLLABLES = "ba ke lo mi nu re sa to vi zu".split()


def words(rng, count):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(count)]


@pytest.fixture(scope="session")
def texts():
    """Texts by doc_id: unrelated ones, near and exact copies, shared passages, odd ones."""
    rng = random.Random(5)
    out = {}
    base = words(rng, 150)
    for at in range(12):
        near = list(base)
        for _ in range(rng.choice((0, 1, 3, 9))):
            near[rng.randrange(len(near))] = words(rng, 1)[0]
        out[at] = " ".join(near)
    out[12] = out[3]
    out[13] = out[3].upper()
    passage = words(rng, 60)
    for at in range(14, 18):
        out[at] = " ".join(words(rng, 40) + passage[: 46 + 4 * (at - 14)] + words(rng, 30))
    out[18], out[19], out[20], out[21] = "", "   \n\t ", "one", "one two"
    out[22] = "one two"
    out[23] = "same " * 400
    out[24] = "x " + "same " * 300 + "y"
    out[25] = " ".join(words(rng, 30_000))
    for at in range(26, 40):
        out[at] = " ".join(words(rng, rng.randint(3, 300)))
    out[40] = "A line.\nA line.\nAnother one.\n\nA line."
    out[41] = "naïve café ﬁn 　 ½ 😀 é"
    return out


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text) as a documents table with further columns, of null or clashing content."""
    def build(rows):
        full = [(i, t, "en" if (i or 0) % 2 else None, None, None, 0.5, 1, 2, 3, 4, 5, 6, 7, 1, 0, 8, "b", "s", True)
                for i, t in rows]
        return spark.createDataFrame(full, COLUMNS)

    return build


@pytest.fixture(scope="session")
def odd_rows(texts):
    """All texts, a null text, rows without doc_id, and rows that repeat."""
    return [*texts.items(), (100, None), (None, "no id " * 30), (None, None), (5, texts[5]), (5, texts[5])]
