"""TEI documents by an event parser: nested divisions, comments, CDATA and character references as XML has them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

TEI_DDL = "title string, abstract string, authors array<string>, sections array<struct<heading:string,text:string>>, references array<string>, tei_error string"
TEI_TYPES = {"title": pa.string(), "abstract": pa.string(), "authors": pa.list_(pa.string()), "sections": pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())])), "references": pa.list_(pa.string()), "tei_error": pa.string()}


class TeiEvents:
    """What a TEI document says, gathered while its elements open and close. Only the local names of elements count.

    A field is open while the element that it stands in is; all text within goes to it, at any depth. Paths are told by
    the names of open elements, so only paragraphs and heads that stand in a top division itself are its own."""

    def __init__(self):
        self.names: list[str] = []
        self.fields: list[tuple[int, str, list[str]]] = []  # depth, what, text
        self.out = {"title": None, "abstract": None, "authors": [], "sections": [], "references": []}
        self.once: set[str] = set()
        self.person: dict[str, str] | None = None
        self.section: dict[str, list[str]] | None = None
        self.reference: list[str] | None = None

    def read(self, xml: str) -> dict:
        from xml.parsers import expat

        p = expat.ParserCreate(namespace_separator=" ")
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.text
        p.Parse(xml.encode(), True)
        return self.out

    def start(self, name: str, _: dict) -> None:
        name = name.rpartition(" ")[2]
        above = self.names[-1] if self.names else ""
        self.names.append(name)
        if name == "title" and above == "titleStmt" or name == "abstract" and above == "profileDesc":
            self.first(name)
        elif name == "persName" and above == "author" and "sourceDesc" in self.names:
            self.person = {}
        elif name in ("forename", "surname") and above == "persName" and self.person is not None and name not in self.person:
            self.person[name] = ""
            self.open(name)
        elif name == "div" and self.names[-3:-1] == ["text", "body"]:
            self.section = {"head": [], "p": []}
        elif name in ("head", "p") and self.names[-4:-1] == ["text", "body", "div"]:
            self.open(name)
        elif name == "biblStruct" and above == "listBibl" and "back" in self.names and self.reference is None:
            self.reference = []
        elif name == "title" and self.reference == []:
            self.reference.append("")
            self.open("reference")

    def first(self, what: str) -> None:
        if what not in self.once:
            self.once.add(what)
            self.open(what)

    def open(self, what: str) -> None:
        self.fields.append((len(self.names), what, []))

    def text(self, data: str) -> None:
        for _, _, parts in self.fields:
            parts.append(data)

    def end(self, name: str) -> None:
        depth = len(self.names)
        while self.fields and self.fields[-1][0] == depth:
            _, what, parts = self.fields.pop()
            said = " ".join("".join(parts).split())
            if what in ("title", "abstract"):
                self.out[what] = said or None
            elif what == "reference":
                self.reference[0] = said
            elif what in ("head", "p"):
                self.section[what].append(said)
            else:
                self.person[what] = said
        name = self.names.pop()
        if name == "persName" and self.person is not None and self.names[-1:] == ["author"]:
            full = " ".join(x for x in (self.person.get("forename"), self.person.get("surname")) if x)
            self.out["authors"] += [full] if full else []
            self.person = None
        elif name == "div" and self.names[-2:] == ["text", "body"] and self.section is not None:
            heading, text = (self.section["head"] or [""])[0] or None, "\n".join(x for x in self.section["p"] if x)
            if heading or text:
                self.out["sections"].append({"heading": heading, "text": text})
            self.section = None
        elif name == "biblStruct" and self.names[-1:] == ["listBibl"] and self.reference is not None:
            self.out["references"] += [x for x in self.reference if x]
            self.reference = None


def read_tei(xml: str | None) -> dict:
    from xml.parsers.expat import ExpatError

    try:
        return {} if xml is None else TeiEvents().read(xml)
    except (ExpatError, UnicodeError) as e:
        return {"tei_error": str(e)}


#: Documents that a worker holds in parsed form, at most.
DOCUMENTS = 64


def few_documents(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices: what is made of documents takes many times their memory, and a batch has up to 10,000."""
    for p in parts:
        for at in range(0, p.num_rows, DOCUMENTS):
            yield p.slice(at, DOCUMENTS)


def parse_tei(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """documents with title, abstract, authors (forename and surname), sections (heading, text: paragraphs, a line each) and
    references (titles) of TEI XML; namespaces play no part; white space collapses; null where there is nothing.

    XML that is broken leaves its document without these and gives tei_error; a null leaves all null. Repeated rows are
    read each; columns of the same names are replaced. Each document is read by itself, a few at a time of an Arrow batch."""
    own = [f for f in documents.schema.fields if f.name not in TEI_TYPES]
    schema = StructType([*own, *_parse_datatype_string(TEI_DDL).fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in few_documents(parts):
            rows = [read_tei(x) for x in p.column(p.schema.get_field_index(xml)).to_pylist()]
            made = [pa.array([r.get(n) for r in rows], t) for n, t in TEI_TYPES.items()]
            yield pa.RecordBatch.from_arrays([*(p.column(p.schema.get_field_index(f.name)) for f in own), *made], names=schema.names)

    return documents.select(*[F.col(f"`{f.name}`") for f in own]).mapInArrow(run, schema)
