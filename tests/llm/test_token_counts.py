"""Token counts encode a word that comes again and again once a batch."""

from chronospan.llm import queries, tokens


def test_repeated_words_are_not_encoded_again(spark, monkeypatch):
    rows = [(i, ("gamma delta naïve 東京 don't " * 400).strip() + f" {i}") for i in range(40)]
    seen = []
    encode, safe = tokens.load(queries.tokenizer_path())
    monkeypatch.setattr(tokens, "load", lambda path: (lambda texts: seen.extend(texts) or encode(texts), safe))
    frame = spark.createDataFrame(rows, "doc_id long, text string")

    class Here:
        """Runs the Arrow function in this process."""

        sparkSession, schema = frame.sparkSession, frame.schema

        def select(self, *columns):
            self.rows = frame.select(*columns)
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            self.out = [r for b in run(iter(self.rows.toArrow().to_batches())) for r in b.to_pylist()]
            return self

        def withColumnRenamed(self, *_):  # noqa: N802
            return self.out

    got = {r["id"]: r["n_tokens"] for r in tokens.count_tokens(Here(), queries.tokenizer_path())}
    assert sum(map(len, seen)) < 10_000
    assert got == {i: len(ids) for (i, _), ids in zip(rows, encode([t for _, t in rows]), strict=True)}
