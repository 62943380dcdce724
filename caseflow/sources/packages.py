"""Zipped form packages: tables of their paragraphs, cells and objects, and what is wrong with a package.

One file is one row. A package's directory is read first: names, sizes and flags decide most errors without unpacking anything. Only then are its XML parts read, each once,
and what later steps need of them is kept. Rows leave a task by Arrow batches, not by files.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

#: The types a package states, parts it needs, the names of its sections and of the parts of its layout, its bounds.
MIMETYPE, FORM_MIMETYPE = "application/hwp", b"application/hwp+zip"
REQUIRED = ["Contents/content.hpf", "Contents/header.xml", "mimetype"]
SECTION = re.compile(r"^Contents/section(\d+)\.xml$")
FIRST_SECTION = ("Contents/section0.xml", "Content/section0.xml")
LAYOUT = ("Contents/header.xml", "Content/header.xml", "settings.xml")
MOST_BYTES, MOST_ENTRIES, MOST_UNPACKED = 25 * 2**20, 10_000, 100 * 2**20
ROWS = "path string, section string, kind string, id string, table int, row int, column int, row_addr int, column_addr int, row_span int, column_span int, text string"
#: Rows of an Arrow batch of package rows.
BATCH_ROWS = 20_000
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError)


@dataclass
class Package:
    """A package as far as it could be read: its errors, and the parsed XML parts of one without errors."""

    errors: list[str] = field(default_factory=list)
    parts: dict = field(default_factory=dict)


def _directory_errors(infos: list[zipfile.ZipInfo]) -> list[str]:
    """What the directory alone says."""
    names = [i.filename for i in infos]
    errors = ["TOO_MANY_ENTRIES"] if len(infos) > MOST_ENTRIES else []
    errors += ["UNSAFE_NAME"] if any(n.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", n) for n in names) else []
    errors += ["DUPLICATE_ENTRY"] if len(set(names)) < len(names) else []
    errors += ["ENCRYPTED_ENTRY"] if any(i.flag_bits & 1 for i in infos) else []
    errors += ["UNPACKED_TOO_LARGE"] if sum(i.file_size for i in infos) > MOST_UNPACKED else []
    errors += [f"PART_MISSING:{n}" for n in REQUIRED if n not in names]
    return errors + ([] if any(SECTION.match(n) for n in names) else ["NO_SECTION"])


def read_package(content: bytes | None) -> Package:
    """A package's errors, codes in order, and its XML parts if there are none. Null is no package."""
    found = Package()
    if content is None:
        found.errors.append("NOT_A_PACKAGE")
        return found
    if len(content) > MOST_BYTES:
        found.errors.append("TOO_LARGE")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            infos = archive.infolist()
            found.errors += _directory_errors(infos)
            names = [i.filename for i in infos]
            if "mimetype" in names and not archive.read("mimetype").decode(errors="replace").strip().startswith(MIMETYPE):
                found.errors.append("MIMETYPE")
            for name in names if not found.errors else ():
                if name.endswith((".xml", ".hpf")):
                    data = archive.read(name)
                    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
                        found.errors.append(f"XML_DECLARATION:{name}")
                        continue
                    try:
                        found.parts[name] = ElementTree.fromstring(data)
                    except ElementTree.ParseError:
                        found.errors.append(f"XML:{name}")
    except _BROKEN:
        found.errors.append("NOT_A_PACKAGE")
    return found


def states_package(content: bytes) -> bool:
    """Whether bytes are a zip whose type is that of form packages and which has a first section; only its directory and the type are read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return archive.read("mimetype").strip() == FORM_MIMETYPE and not set(FIRST_SECTION).isdisjoint(archive.namelist())
    except (KeyError, *_BROKEN):
        return False


def well_formed(content: bytes) -> bool:
    """Whether bytes are XML without a DTD or entities anywhere."""
    plain = bytes(content).upper().replace(b"\0", b"")
    if b"<!DOCTYPE" in plain or b"<!ENTITY" in plain:
        return False
    try:
        ElementTree.fromstring(content)
    except (ElementTree.ParseError, ValueError, LookupError):
        return False
    return True


def _name(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element) -> str:
    return "".join(x.text or "" for x in element.iter() if _name(x) == "t")


def package_rows(path: str, package: Package) -> Iterator[tuple]:
    """Paragraphs, cells and objects of a package, as rows of ROWS."""
    for part in sorted((n for n in package.parts if SECTION.match(n)), key=lambda n: int(SECTION.match(n)[1])):
        section = part.removeprefix("Contents/").removesuffix(".xml")
        paragraphs, tables, objects = [], [], []
        for i, element in enumerate(package.parts[part].iter()):
            kind = _name(element)
            if kind == "p":
                paragraphs.append(element)
            elif kind == "tbl":
                tables.append(element)
            elif kind in ("pic", "img", "image"):
                objects.append((i, kind))
        for i, p in enumerate(paragraphs):
            yield (path, section, "paragraph", f"{section}.paragraph{i}", *[None] * 7, _text(p))
        for t, table in enumerate(tables):
            for r, row in enumerate(x for x in table if _name(x) == "tr"):
                for c, cell in enumerate(x for x in row if _name(x) == "tc"):
                    own = {_name(x): x.attrib for x in reversed(list(cell))}
                    at, span = own.get("cellAddr", {}), own.get("cellSpan", {})
                    place = (int(at.get("rowAddr", r)), int(at.get("colAddr", c)), int(span.get("rowSpan", 1)), int(span.get("colSpan", 1)))
                    yield (path, section, "cell", f"{section}.table{t}.row{r}.cell{c}", t, r, c, *place, _text(cell))
        # an object's number counts all elements of the section before it
        for i, kind in objects:
            yield (path, section, "object", f"{section}.object{i}", *[None] * 7, kind)


def layout_fingerprint(package: Package) -> str:
    """SHA-256 of a package's header and settings, and of its sections with their texts taken out. White space between elements doesn't count, so an indented copy has the same one."""
    digest = sha256()
    for part in [*LAYOUT, *sorted(n for n in package.parts if SECTION.match(n))]:
        if part not in package.parts:
            continue
        root = package.parts[part]
        for x in root.iter():
            if SECTION.match(part) and _name(x) == "t" or x.text is not None and not x.text.strip():
                x.text = None
            if x.tail is not None and not x.tail.strip():
                x.tail = None
        digest.update(part.encode() + b"\0" + ElementTree.canonicalize(ElementTree.tostring(root, encoding="unicode")).encode() + b"\0")
    return digest.hexdigest()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield _batch(held, schema)
            held = []
    yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def extract_package_tables(files: DataFrame) -> DataFrame:
    """Rows of ROWS (kind: paragraph, cell, object) of the valid packages of ``files`` (path, content), as ``binaryFile`` reads them; others give none (see ``validate_packages``)."""
    schema = _schema(ROWS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(*batch.columns, strict=True):
                    package = read_package(content.as_py())
                    if not package.errors:
                        yield from package_rows(path.as_py(), package)

        return _batches(rows(), schema)

    return files.select("path", "content").mapInArrow(parse, ROWS)


def validate_packages(files: DataFrame) -> DataFrame:
    """(path, valid, errors, fingerprint) of every package of ``files`` (path, content); only valid ones have a layout fingerprint."""
    ddl = "path string, valid boolean, errors array<string>, fingerprint string"
    schema = _schema(ddl)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(*batch.columns, strict=True):
                    package = read_package(content.as_py())
                    yield path.as_py(), not package.errors, package.errors, None if package.errors else layout_fingerprint(package)

        return _batches(rows(), schema)

    return files.select("path", "content").mapInArrow(check, ddl)
