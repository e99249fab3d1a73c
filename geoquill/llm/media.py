"""Media columns: texts as lossless WebP images, read back to arrays of samples.

A payload (bytes, zero-padded to a positive multiple of 64) becomes an image of ARGB pixels, four bytes each, of 16 pixels a row, or as many as
the format's height needs; bytes beyond the payload in the last row are zero. `stored` gives the file, `samples` the bytes that its
pixels hold.

Scale: one pass, no shuffle; a task holds one Arrow batch of texts and files, encodes WRITTEN and decodes TOGETHER payload bytes at once, so that one array operation
serves many files.

Defined cases: null counts as an empty text, whose payload is 64 zero bytes; equal texts give equal values; null and repeated ids are kept; texts are stored whole, but one
beyond 1 GB of UTF-8 doesn't fit the format's 2^28 pixels and fails; an empty table gives an empty result; extra columns are carried, but n_bytes, payload_size and
media are overwritten. No value is compared, so there are no ties.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquill.llm import webp
from geoquill.llm.common import prepare, read, text_of

UNIT, ROW, MOST = 64, 16, 16384
TOGETHER, WRITTEN = 6 << 20, 1 << 20


def payload(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0")


def _image(data: bytes) -> np.ndarray:
    n = len(data) // 4
    width = ROW if n <= ROW * MOST else MOST
    height = -(-n // width)
    return np.frombuffer(data.ljust(4 * width * height, b"\0"), ">u4").astype(np.uint32).reshape(height, width)


def stored(data: bytes) -> bytes:
    """The WebP file of a payload."""
    return webp.encode(_image(data))


def all_stored(payloads: Iterable[bytes]) -> Iterator[bytes]:
    """stored() of many payloads, encoded together, WRITTEN bytes at once."""
    images, held = [], 0
    for p in payloads:
        if images and held + len(p) > WRITTEN:
            yield from webp.encode_many(images)
            images, held = [], 0
        images.append(_image(p))
        held += len(p)
    yield from webp.encode_many(images) if images else ()


def samples(file: bytes, n: int) -> bytes:
    """The first n bytes that a file's pixels hold."""
    return webp.decode(file).astype(">u4").tobytes()[:n]


def all_samples(files: Sequence[bytes], sizes: Sequence[int]) -> Iterator[bytes]:
    """samples() of many files, decoded together, TOGETHER payload bytes at once."""
    at = 0
    while at < len(files):
        end, held = at, 0
        while end < len(files) and (end == at or held + sizes[end] <= TOGETHER):
            held += sizes[end]
            end += 1
        for pixels, n in zip(webp.decode_many(files[at:end]), sizes[at:end], strict=True):
            yield pixels.astype(">u4").tobytes()[:n]
        at = end


def features(data: bytes) -> str:
    """Mean and spread of the samples, distinct values, and the 16-bin histogram's largest bin."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    values = np.arange(256)
    mean = (counts * values).sum() / len(data)
    spread = ((counts * (values - mean) ** 2).sum() / len(data)) ** 0.5
    bins = counts.reshape(16, 16).sum(1)
    return f"mean={mean:.3f};std={spread:.3f};distinct={np.count_nonzero(counts)};bin={int(bins.argmax())}:{bins.max() / len(data):.3f}"


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(texts: pd.Series) -> pd.Series:
    different = list(dict.fromkeys(texts))  # copies within an Arrow batch are encoded once
    made = dict(zip(different, all_stored(payload(t.encode("utf-8", "surrogatepass")) for t in different), strict=True))
    return pd.Series([made[t] for t in texts])


def digest(files: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    rows = []
    for file, data in zip(files, all_samples(files.tolist(), sizes.tolist()), strict=True):
        rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), features(data)))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def with_media(docs: DataFrame) -> DataFrame:
    """docs with n_bytes (of the text), payload_size and media, the WebP file."""
    size = F.octet_length(text_of()).cast("long")
    padded = F.greatest(F.lit(1), F.ceil(size / UNIT)) * UNIT
    return docs.withColumns({"n_bytes": size, "payload_size": padded.cast("long"), "media": F.pandas_udf(store, "binary")(text_of())})


def op5_media_column(spark, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return with_media(docs).select("doc_id", "n_bytes", F.pandas_udf(digest, DIGEST)("media", "payload_size").alias("d")).select("doc_id", "n_bytes", "d.*")
