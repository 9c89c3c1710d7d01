"""Main text of HTML pages by a recurrent block labeller.

A page is its sequence of text blocks. A bidirectional LSTM reads, for each block, its tag path (tags and class,
id and role names, hashed), its hashed words and a few numbers, and labels it with the whole page in view. The kept
blocks, in page order, are the text. The labeller is trained on generated pages (see html_pages) with a fixed
seed, once per driver, and its weights (under 1 MB) are broadcast.

Defined cases: null or empty html, and pages without main text, give the empty string; markup that never closes is read as
far as it goes; repeated rows are extracted each; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from parlance.llm.html_blocks import WIDTH, blocks, vectors
from parlance.llm.html_pages import labelled_pages
from parlance.llm.lstm import BiLstm

HIDDEN, PAGES, ROUNDS = 20, 2000, 15


@lru_cache(maxsize=1)
def labeller() -> BiLstm:
    model = BiLstm(WIDTH, HIDDEN)
    model.fit([(vectors(b), y) for b, y in labelled_pages(PAGES)], ROUNDS)
    return model


def extract_texts(pages: list[str | None], model: BiLstm) -> list[str]:
    found = [blocks(p or "") for p in pages]
    kept = model.label([vectors(b) for b in found])
    return ["\n".join(b.text for b, k in zip(bs, ks, strict=True) if k) for bs, ks in zip(found, kept, strict=True)]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller())

    def extract(batches):
        import pyarrow as pa

        model = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = extract_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
