import hashlib


def vector_table(spark, spaces):
    """(model, split, row_idx, embedding) from {model: (docs, queries)}."""
    rows = [
        (model, split, n, [float(x) for x in v])
        for model, both in spaces.items()
        for split, matrix in zip(("corpus", "queries"), both)
        for n, v in enumerate(matrix)
    ]
    return spark.createDataFrame(rows, "model string, split string, row_idx long, embedding array<float>")


def train_rows(n, size, seed=42):
    """Rows of the seeded training split."""
    return sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:split{i}".encode()).hexdigest())[:size]
