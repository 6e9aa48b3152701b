import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Nulls, empties, repeated rows, odd characters and a long text, for every operator on documents.
EDGES = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (None, "a null id stands here", "en", "a", 21),
    (4, "the same row twice", "en", "a", 18),
    (4, "the same row twice", "en", "a", 18),
    (5, " \t\n ", "en", "a", 4),
    (6, "naïve café ÀÉ ſ İstanbul Σς 你好 é <|endoftext|> 's don't 12 ½", "fr", "b", 30),
    (7, "long " * 20000, "en", "b", 100000),
    (8, "\u0001\u0002 marks \u0001", None, "b", 10),
]


def documents(spark, rows=EDGES):
    return spark.createDataFrame(rows, DOCS)


def clashing(spark, *names):
    """The edge rows with columns whose names computed ones have too."""
    df = documents(spark)
    for n in names:
        df = df.selectExpr("*", f"'x' as {n}")
    return df


def words(seed, n, vocabulary=40):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
