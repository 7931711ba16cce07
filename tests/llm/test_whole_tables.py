"""Queries without a SQL twin, over their whole tables, against brute-force versions written from their contracts."""

import hashlib
import html.parser
import re
from collections import Counter

import zstandard

from plumbline.llm import queries, quality

FOLDER = "/root/testdata/sf0.01"


class Article(html.parser.HTMLParser):
    """The text of the article elements of the tables' pages: what stands between block tags is a block."""

    INLINE = ("a", "b", "i", "em", "strong", "span", "u")

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.blocks = 0, [], [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id")).split()
        if tag == "article":
            self.depth += 1
        if self.skip and self.skip[-1] == tag or self.depth and (tag in ("script", "style", "form", "aside", "nav", "footer", "header", "button") or {"ad", "share", "comments", "related", "newsletter", "cookie"} & set(named)):
            self.skip.append(tag)
        if tag not in self.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()
        if tag == "article":
            self.depth -= 1
        if tag not in self.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.blocks[-1] += data

    @property
    def text(self):
        return " ".join(t for t in (" ".join(b.split()) for b in self.blocks) if t)


def test_op8_over_all_pages(spark):
    got = {r["page_id"]: r for r in queries.op8_html_text(spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        row = got[page["page_id"]]
        assert (row["url"], row["text"]) == (page["url"], Article(page["html"] or "").text)
        assert row["n_chars"] == len(row["text"])


def base_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    counts = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed


def within_bands(raw):
    size = lambda part: len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(part)) / len(part)
    band = [b for b in quality.BANDS if b[0] <= len(raw)]
    if not band:
        return True
    chunks = [raw[at : at + 4096] for at in range(0, len(raw) - 4095, 4096)]
    if chunks and len(raw) % 4096:
        chunks.append(raw[-4096:])
    outside = [c for c in chunks if not 0.25 <= size(c) <= 0.70]
    return band[-1][1] <= size(raw) <= band[-1][2] and len(outside) <= 0.2 * len(chunks)


def test_op10_over_all_documents(spark):
    got = {r["doc_id"]: r for r in queries.op10_quality_rules(spark, FOLDER).collect()}
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(documents)
    for document in documents:
        text, row = document["text"] or "", got[document["doc_id"]]
        base = base_of(text)
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"], row["base_failed"]) == base
        assert row["kept"] == (not base[-1] and within_bands(text.encode()))
    assert 0.5 < sum(r["kept"] for r in got.values()) / len(got) < 1


def test_op1_over_all_documents(spark):
    import tiktoken

    from tests.llm.test_bpe import library

    encoding: tiktoken.Encoding = library()
    got = {r["doc_id"]: r for r in queries.op1_byte_bpe(spark, FOLDER).collect()}
    for document in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = encoding.encode_ordinary(document["text"] or "")
        row = got.pop(document["doc_id"])
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert not got
