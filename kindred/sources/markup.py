"""Book markup -> raw fields. A small per-document reader used inside one Arrow batch function.

Only text nodes are collected here; trimming, sampling and joining are column expressions.
"""

from __future__ import annotations

from html.parser import HTMLParser
from xml.parsers import expat

# Fixed value: the namespace of the book format.
BOOK_NAMESPACE = "http://www.gribuser.ru/xml/fictionbook/2.0"


class _Fields:
    """Collects text nodes while a parser reports starts, ends and text."""

    def __init__(self, namespace: str | None):
        self.namespace = namespace
        self.stack: list[str] = []
        self.node: list[str] = []
        self.paragraphs: list[str] = []
        self.description: list[str] = []
        self.authors: list[dict] = []
        self.title: list[str] | None = None
        self.doc_id: list[str] | None = None
        self._capture: tuple[int, list[str]] | None = None
        self._name_part: str | None = None

    def start(self, name: str) -> None:
        self.flush()
        parent = self.stack[-1] if self.stack else ""
        self.stack.append(name)
        if name == "author" and parent == "title-info":
            self.authors.append({})
        elif name == "book-title" and self.title is None:
            self.title = []
            self._capture = (len(self.stack), self.title)
        elif name == "id" and parent == "document-info" and self.doc_id is None:
            self.doc_id = []
            self._capture = (len(self.stack), self.doc_id)
        elif name in _NAME_PARTS and self.stack[-3:-1] == ["title-info", "author"]:
            # The first element of a name part counts, up to its first child.
            if _NAME_PARTS[name] not in self.authors[-1]:
                self._name_part = _NAME_PARTS[name]
                self.authors[-1][self._name_part] = ""

    def text(self, data: str) -> None:
        if self._capture:
            self._capture[1].append(data)
        self.node.append(data)

    def end(self) -> None:
        self.flush()
        if self._capture and self._capture[0] == len(self.stack):
            self._capture = None
        self.stack.pop()

    def flush(self) -> None:
        """Close the current text node and file it by where it stands."""
        data, self.node = "".join(self.node), []
        part, self._name_part = self._name_part, None
        path = self.stack
        if not data or not path:
            return
        if path[-1] == "p":
            if "body" in path[:-1] and "annotation" not in path and "note" not in path:
                self.paragraphs.append(data)
            if "annotation" in path[:-1] and _child_of(path, "title-info", "annotation"):
                self.description.append(data)
        elif part:
            self.authors[-1][part] = data

    def as_row(self) -> dict:
        return {
            "paragraphs": self.paragraphs,
            "title": None if self.title is None else "".join(self.title),
            "authors": [
                {part: a.get(part) for part in ("first", "middle", "last")} for a in self.authors
            ],
            "description": self.description,
            "doc_id": None if self.doc_id is None else "".join(self.doc_id),
        }


# The elements of a person's name.
_NAME_PARTS = {"first-name": "first", "middle-name": "middle", "last-name": "last"}


def _child_of(path: list[str], parent: str, child: str) -> bool:
    return any(a == parent and b == child for a, b in zip(path, path[1:]))


class _Forgiving(HTMLParser):
    """Reads what can be read of malformed markup: closes what was left open."""

    CDATA_CONTENT_ELEMENTS = ()
    RCDATA_CONTENT_ELEMENTS = ()

    def __init__(self, fields: _Fields, sloppy_paragraphs: bool):
        super().__init__(convert_charrefs=True)
        self.fields = fields
        self.sloppy_paragraphs = sloppy_paragraphs
        if sloppy_paragraphs:
            self.CDATA_CONTENT_ELEMENTS = HTMLParser.CDATA_CONTENT_ELEMENTS
            self.RCDATA_CONTENT_ELEMENTS = getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())
        self.open: list[str] = []
        self.prefixes: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        if self.sloppy_paragraphs and tag in _VOID:
            self.fields.flush()
            return
        if self.sloppy_paragraphs and tag == "p" and "p" in self.open:
            self.handle_endtag("p")
        self._declare(attrs)
        self.open.append(tag)
        self.fields.start(self._name(tag))

    def handle_startendtag(self, tag, attrs):
        self._declare(attrs)
        self.fields.start(self._name(tag))
        self.fields.end()

    def handle_endtag(self, tag):
        if tag in self.open:
            while True:
                closed = self.open.pop()
                self.fields.end()
                if closed == tag:
                    break

    def handle_data(self, data):
        self.fields.text(data)

    def handle_comment(self, data):
        self.fields.flush()

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.fields.text(data[6:])

    def finish(self):
        self.close()
        while self.open:
            self.open.pop()
            self.fields.end()

    def _declare(self, attrs):
        for name, value in attrs:
            if name == "xmlns":
                self.prefixes[""] = value
            elif name.startswith("xmlns:"):
                self.prefixes[name[6:]] = value

    def _name(self, tag: str) -> str:
        prefix, _, local = tag.rpartition(":")
        wanted = self.fields.namespace
        if wanted is not None and self.prefixes.get(prefix) != wanted:
            return ":" + tag
        return local


# Elements without an end tag.
_VOID = ("area base br col embed hr img input link meta source track wbr").split()


def read_fields(content: bytes | str, namespace: str | None = BOOK_NAMESPACE) -> dict:
    """Raw fields of one document; ``recovered`` tells that its markup was broken.

    ``namespace=None`` accepts elements of any namespace and reads the text as a web page.
    """
    if isinstance(content, str):
        content = content.encode("utf-8")
    if namespace is not None:
        fields = _Fields(namespace)
        try:
            _read_strict(content, fields)
            return {**fields.as_row(), "recovered": False}
        except expat.ExpatError:
            pass
    fields = _Fields(namespace)
    parser = _Forgiving(fields, sloppy_paragraphs=namespace is None)
    parser.feed(_decode(content))
    parser.finish()
    return {**fields.as_row(), "recovered": True}


def sample(paragraphs: list[str], per_part: int) -> list[str]:
    """First, middle and last paragraphs, as ``functions.text.sample_paragraphs`` takes them."""
    n = len(paragraphs)
    middle = max(per_part, n // 2 - per_part // 2)
    return (
        paragraphs[:per_part]
        + (paragraphs[middle : middle + per_part] if n > 2 * per_part else [])
        + paragraphs[-per_part:]
    )


def _read_strict(content: bytes, fields: _Fields) -> None:
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def start(name, attrs):
        space, _, local = name.rpartition(" ")
        fields.start(local if space == fields.namespace else ":" + local)

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda name: fields.end()
    parser.CharacterDataHandler = fields.text
    parser.CommentHandler = lambda data: fields.flush()
    parser.ProcessingInstructionHandler = lambda target, data: fields.flush()
    parser.Parse(content, True)


def _decode(content: bytes) -> str:
    head = content[:200].decode("latin-1")
    declared = head.partition('encoding="')[2].partition('"')[0]
    try:
        return content.decode(declared or "utf-8")
    except (LookupError, UnicodeDecodeError):
        return content.decode("utf-8", errors="replace")
