"""HTML to Markdown with numbered references; parsing needs Python, so it runs in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements whose content isn't text of the page.
DROPPED = {"nav", "footer", "script", "style", "aside", "form", "iframe", "noscript"}
# Elements that never hold anything, so that no end tag closes them.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Collects lines of text and absolute links. open: the elements that are open, so that what an end tag closes is
    known; an element that is left open ends with the one around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.lines: list[str] = []
        self.links: list[tuple[str, list[str]]] = []
        self.inside: list[tuple[int, int]] = []

    def _hidden(self) -> bool:
        return any(x in DROPPED for x in self.open)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        href = dict(attrs).get("href") if tag == "a" and not self._hidden() else None
        if href and href.startswith(("http://", "https://")):
            self.inside.append((len(self.open), len(self.links)))
            self.links.append((href, []))
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            self.inside = [x for x in self.inside if x[0] < len(self.open)]

    def handle_data(self, data):
        if self._hidden():
            return
        self.lines += [x for x in (line.strip() for line in data.splitlines()) if x]
        for _, k in self.inside:
            self.links[k][1].append(data.strip())


def to_markdown(html: str | None) -> tuple[str, int]:
    """The page's text lines, then its absolute links, numbered, each once; and how many there are."""
    if not (html or "").strip():
        return "", 0
    page = _Page()
    page.feed(html)
    page.close()
    text, numbered = "\n".join(page.lines), {}
    for url, said in page.links:
        if url not in numbered:
            shown = "".join(said)
            numbered[url] = f"[{len(numbered) + 1}] {url}" + (f": {shown}" if shown else "")
    if numbered:
        text += "\n\n## References\n\n" + "\n".join(numbered.values())
    return text, len(numbered)


def clean_pages(pages: DataFrame) -> DataFrame:
    """page_id, markdown and n_links of page_id, html."""

    def run(tables):
        for t in tables:
            found = [to_markdown(h) for h in t.column("html").to_pylist()]
            yield pa.record_batch([t.column("page_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())],
                                  ["page_id", "markdown", "n_links"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, markdown string, n_links long")
