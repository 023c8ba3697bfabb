"""Content extraction: decoding, sniffing, symbols, budgets, and a registry of pluggable extractors."""

from __future__ import annotations

import ast
import codecs
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.functions.batches import pieces

EXTRACTOR_ID, EXTRACTOR_VERSION, ABI_VERSION = "native", 1, 1

# Extensions by format.
LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "go": "go", "c": "c", "h": "c",
}
TEXT = frozenset(
    "txt md markdown json toml yaml yml xml html htm css csv log sh zsh bash ini cfg conf sql".split()
)
IMAGES = frozenset("png jpg jpeg gif bmp tiff tif heic webp".split())
MEDIA = frozenset("mp3 m4a mp4 m4v mov wav flac aac".split())

_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_NAME = r"([^\W\d]\w*)"
#: (kind, pattern whose first group is the name) of definitions; Python is parsed instead while it is valid.
_DEFINITIONS = {
    "rust": [("function", rf"\bfn\s+{_NAME}"), ("type", rf"\b(?:struct|enum|trait|mod)\s+{_NAME}")],
    "python": [("function", rf"^[ \t]*(?:async\s+)?def\s+{_NAME}"), ("type", rf"^[ \t]*class\s+{_NAME}")],
    "javascript": [
        ("function", rf"\bfunction\s*\*?\s*{_NAME}\s*\("),
        ("function", rf"^[ \t]*(?:static\s+|async\s+|get\s+|set\s+|\*\s*)*(?!(?:if|for|while|switch|catch|function|return)\b){_NAME}\s*\([^;{{}}]*\)\s*\{{"),
        ("type", rf"\bclass\s+{_NAME}"),
    ],
    "go": [("function", rf"^func\s+(?:\([^)]*\)\s*)?{_NAME}"), ("type", rf"^type\s+{_NAME}")],
    "c": [
        ("function", rf"^[A-Za-z_][\w\s\*]*?\b{_NAME}\s*\([^;{{}}]*\)\s*\{{"),
        ("type", rf"\b(?:struct|enum)\s+{_NAME}\s*\{{"),
        ("type", rf"^typedef\b[^;{{}}]*?\b{_NAME}\s*;"),
    ],
}
_COMPILED = {lang: [(kind, re.compile(p, re.M)) for kind, p in rules] for lang, rules in _DEFINITIONS.items()}


@dataclass(frozen=True)
class Budgets:
    max_input_bytes: int = 32 << 20
    max_output_bytes: int = 2 << 20
    max_symbols: int = 5000


@dataclass
class Extraction:
    status: str
    text: str = ""
    attrs: list[tuple[str, str]] = field(default_factory=list)
    symbols: list[tuple[str, str, int]] = field(default_factory=list)


def extension(name: str) -> str:
    base = name.rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[1].lower() if "." in base[1:] else ""


def binary(raw: bytes) -> bool:
    return b"\0" in raw[:8192]


def decode(raw: bytes) -> str | None:
    """Text by byte-order mark, else UTF-8 with replacements; None for binary content."""
    for bom, name in _BOMS:
        if raw.startswith(bom):
            return raw[len(bom) :].decode(name, "replace")
    return None if binary(raw) else raw.decode("utf-8", "replace")


def sniff(name: str, raw: bytes) -> str:
    """pdf, source, text or binary: by magic bytes, then extension, then content."""
    ext = extension(name)
    if raw.startswith(b"%PDF-") or ext == "pdf":
        return "pdf"
    if ext in LANGUAGES:
        return "source"
    return "text" if ext in TEXT or not binary(raw) else "binary"


def symbols(language: str, text: str) -> list[tuple[str, str, int]]:
    """(name, kind, 1-based line) of definitions, by position."""
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            pass
        else:
            kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "type"}
            found = [(n.lineno, n.col_offset, n.name, kinds[type(n)]) for n in ast.walk(tree) if type(n) in kinds]
            return [(name, kind, line) for line, _, name, kind in sorted(found)]
    found = {}
    for kind, pattern in _COMPILED[language]:
        for m in pattern.finditer(text):
            found.setdefault(m.start(1), (m[1], kind, text.count("\n", 0, m.start(1)) + 1))
    return [found[at] for at in sorted(found)]


def _cut(text: str, limit: int) -> str:
    return text.encode("utf-8", "surrogatepass")[:limit].decode("utf-8", "ignore")


def extract(name: str, raw: bytes, full_size: int | None = None, budgets: Budgets = Budgets()) -> Extraction:
    """A typed record for a file's first bytes. Budgets that are overrun are named in attrs; one on the input outranks the
    other statuses. PDF text needs a reader that is registered as a plug-in."""
    cut_short = len(raw) < (len(raw) if full_size is None else full_size)
    out = Extraction("complete", attrs=[("extractor", f"{EXTRACTOR_ID}/{EXTRACTOR_VERSION}")])
    kind = sniff(name, raw)
    text = decode(raw) if kind in ("source", "text") else None
    if text is None:
        out.status = "unsupported"
        return out
    out.text = text
    if kind == "source":
        out.symbols = symbols(LANGUAGES[extension(name)], text)
        out.attrs.append(("language", LANGUAGES[extension(name)]))
    if len(text.encode("utf-8", "surrogatepass")) > budgets.max_output_bytes:
        out.text, out.status = _cut(text, budgets.max_output_bytes), "partial"
        out.attrs.append(("partial_reason", "output_budget"))
    if len(out.symbols) > budgets.max_symbols:
        out.symbols, out.status = out.symbols[: budgets.max_symbols], "partial"
        out.attrs.append(("partial_reason", "symbol_budget"))
    if cut_short:
        out.status = "budget-exceeded"
        out.attrs.append(("partial_reason", "input_budget"))
    return out


@dataclass(frozen=True)
class Processor:
    """A plug-in: its identity joins the content key, so another version extracts anew."""

    id: str
    version: int
    extensions: frozenset[str]
    run: Callable[[str, bytes], Extraction]


class Registry:
    """Plug-ins by extension; the last one registered wins an extension, and the native extractor takes the rest."""

    def __init__(self, budgets: Budgets = Budgets()) -> None:
        self.budgets = budgets
        self._by: dict[str, Processor] = {}

    def register(self, processor: Processor) -> None:
        for ext in processor.extensions:
            self._by[ext] = processor

    def key(self, name: str) -> tuple[str, int]:
        found = self._by.get(extension(name))
        return (found.id, found.version) if found else (EXTRACTOR_ID, EXTRACTOR_VERSION)

    def run(self, name: str, raw: bytes, full_size: int | None = None) -> Extraction:
        found = self._by.get(extension(name))
        try:
            return found.run(name, raw) if found else extract(name, raw, full_size, self.budgets)
        except Exception as error:  # a plug-in's failure is a status of its file, not of the job
            return Extraction("corrupt", attrs=[("error", f"{type(error).__name__}: {error}"[:200])])


_KIND = (
    "status string, text string, attrs array<struct<k:string,v:string>>, symbols array<struct<name:string,kind:string,line:int>>, "
    "extractor_id string, extractor_version int"
)
_ATTRS = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))
_SYMBOLS = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32())]))


def extract_files(files: DataFrame, registry: Registry | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """files (path, content: binary, length, and keys) -> keys and the extraction; reads at most the input budget of each.
    Texts of a piece of a batch are held at a time."""
    registry = registry or Registry()
    names = list(keys)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "content")):
            paths = batch.column("path").to_pylist()
            sizes = batch.column("length").to_pylist()
            done = [
                registry.run(p, (raw.as_py() or b"")[: registry.budgets.max_input_bytes], n)
                for p, raw, n in zip(paths, batch.column("content"), sizes)
            ]
            by = [registry.key(p) for p in paths]
            cols = [batch.column(n) for n in names]
            cols += [pa.array([d.status for d in done], pa.string()), pa.array([d.text for d in done], pa.string())]
            cols += [pa.array([[{"k": k, "v": v} for k, v in d.attrs] for d in done], _ATTRS)]
            cols += [pa.array([[{"name": n, "kind": k, "line": i} for n, k, i in d.symbols] for d in done], _SYMBOLS)]
            cols += [pa.array([k for k, _ in by], pa.string()), pa.array([v for _, v in by], pa.int32())]
            labels = names + ["status", "text", "attrs", "symbols", "extractor_id", "extractor_version"]
            yield pa.RecordBatch.from_arrays(cols, labels)

    wanted = list(dict.fromkeys([*names, "path", "content", "length"]))
    kinds = dict(files.dtypes)
    return files.select(*wanted).mapInArrow(rows, ", ".join(f"{n} {kinds[n]}" for n in names) + ", " + _KIND)
