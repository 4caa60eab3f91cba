"""Pages of PDF files by a pluggable page reader, each file in a task of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.sources.readers import WORDS

#: A reader takes a file's bytes and yields (page from 1, page height, words); a word is (x0, y0, x1, y1, token, block, line, word).
PageReader = Callable[[bytes], Iterator[tuple[int, float, list[tuple]]]]


def default_reader(content: bytes) -> Iterator[tuple[int, float, list[tuple]]]:
    try:
        import fitz
    except ImportError as e:
        raise ImportError("reading PDF files needs PyMuPDF, or a page reader of your own") from e
    with fitz.open(stream=content, filetype="pdf") as file:
        for number, page in enumerate(file, start=1):
            yield number, page.rect.height, page.get_text("words")


def pdf_words(files: DataFrame, reader: PageReader = default_reader) -> DataFrame:
    """The words table (one row per word with its place) of files with ``path`` and ``content``."""
    names = [c.strip().split()[0] for c in WORDS.split(",")]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for page, height, words in reader(content):
                    rows = [(path, page, float(height), *map(float, w[:4]), str(w[4]), *map(int, w[5:8])) for w in words]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) if isinstance(c[0], int) else pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, WORDS)
