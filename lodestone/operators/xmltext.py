"""Text of article XML: dialects, a ladder of parsers, blocks in document order, references."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small

#: For each dialect, by local name: elements of the body that end a block, and entries of the list of references.
BLOCKS = {
    "tei": ({"p", "head", "list", "item", "figure", "table", "lg", "l"}, {"biblstruct", "bibl"}),
    "jats": ({"p", "title", "list", "disp-formula", "fig", "table-wrap", "statement", "boxed-text", "verse-group"}, {"ref"}),
    "wiley": ({"p", "title", "list", "figure", "tabular", "displayeditem", "section"}, {"bib"}),
}
REFERENCES = {"listbibl", "ref-list", "bibliography"}
#: Sections behind the body of an article: (element, kind of notes or None, title if it has none).
BACK = (
    ("ack", None, "Acknowledgements"),
    ("notes", "author-contribution", "Author contributions"),
    ("notes", "data-availability", "Data availability"),
    ("notes", "COI-statement", "Competing interests"),
    ("sec", "supplementary", "Supplementary information"),
    ("fn-group", None, "Footnotes"),
)
MAX_BROKEN = 500_000


def dialect(content: Column) -> Column:
    """By what stands in the first 2,048 characters."""
    head = F.left(content, F.lit(2048))
    return (
        F.when(head.contains("http://www.tei-c.org/ns/1.0"), "tei").when(head.rlike("(NLM|TaxonX)//DTD"), "jats")
        .when(head.contains("http://www.wiley.com/namespaces/wiley"), "wiley").when(head.contains("BioC.dtd"), "bioc").otherwise("unknown")
    )


def parse(content: str | None) -> tuple[ET.Element | None, str, str | None]:
    """(root, method, error): as it is, with DOIs mended and bare ampersands escaped, then what can be cut out of it."""
    if not content:
        return None, "none", "empty"
    mended = re.sub(r"&(?!#?\w+;)", "&amp;", re.sub(r"(10\.\d{4,})\s*/\s+", r"\1/", content))
    cut = mended[:MAX_BROKEN]
    cut = cut[: cut.rfind(">") + 1]
    error = None
    for method, text in (("standard", content), ("mended", mended), ("cut", cut), ("wrapped", f"<root>{cut}</root>")):
        try:
            return ET.fromstring(text), method, None
        except (ET.ParseError, ValueError) as e:
            error = str(e)
    return None, "failed", error


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def flat(e: ET.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def entry(text: str) -> str:
    """A reference on one line: a period after initials, one at the end."""
    text = re.sub(r"\b([A-Z])(?=\s[A-Z][a-z])", r"\1.", " ".join(text.split()))
    return text if not text or text.endswith(".") else text + "."


def blocks(e: ET.Element, ends: set[str], skip=frozenset(), done=frozenset()) -> list[str]:
    """Text of an element in order, each innermost block once. Neither elements named in ``skip`` nor those of ``done`` (by
    identity) are entered. Nesting may be of any depth."""
    out: list[str] = []
    line: list[str] = []

    def close():
        if t := " ".join("".join(line).split()):
            out.append(t)
        line.clear()

    todo: list = [e]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif local(x) not in skip and id(x) not in done:
            if local(x) in ends:
                close()
                todo.append(None)
            for c in reversed(x):
                todo += [c.tail or "", c]
            line.append(x.text or "")
    close()
    return out


def first(e: ET.Element | None, *names: str) -> ET.Element | None:
    """The first element below of the first name that there is."""
    if e is not None:
        for n in names:
            if (hit := next((x for x in e.iter() if x is not e and local(x) == n), None)) is not None:
                return hit
    return None


def below(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if e is None else [x for x in e.iter() if local(x) == name]


def titled(e: ET.Element, default: str, ends: set[str]) -> list[str]:
    """A section: its own title, or ``default``, then its blocks; nothing if it has no text."""
    title = next((c for c in e if local(c) == "title"), None)
    text = blocks(e, ends, done=frozenset() if title is None else frozenset([id(title)]))
    return [(flat(title) if title is not None else "") or default, *text] if text else []


def entries(root: ET.Element, names: set[str]) -> list[str]:
    """References of all lists, each once, under a heading of their own."""
    found: dict[int, str] = {}
    for x in root.iter():
        if local(x) in REFERENCES:
            for r in x.iter():
                if local(r) in names:
                    cited = next((c for c in r if local(c) == "citation"), r)
                    found.setdefault(id(r), entry(flat(cited)))
    out = [t for t in found.values() if t]
    return ["References", *out] if out else []


def jats(root: ET.Element) -> list[str]:
    ends, names = BLOCKS["jats"]
    front, body, back = first(root, "front"), first(root, "body"), first(root, "back")
    out = [t for x in (first(front, "article-title"), first(front, "abstract")) if x is not None for t in blocks(x, ends)]
    out += [] if body is None else blocks(body, ends, REFERENCES)
    done: set[int] = set()
    for name, kind, title in BACK:
        for x in below(back, name):
            if name == "notes" and x.get("notes-type") != kind:
                continue
            if name == "sec" and kind not in flat(next((c for c in x if local(c) == "title"), ET.Element("title"))).lower():
                continue
            if id(x) not in done and (text := titled(x, title, ends | {"fn"})):
                out += text
                done.update(id(y) for y in x.iter())
                break
    return out + entries(root, names)


def wiley(root: ET.Element) -> list[str]:
    ends, names = BLOCKS["wiley"]
    header, body = first(root, "header"), first(root, "body")
    meta, out = first(header, "contentmeta") if header is not None else None, []
    titles = [x for x in below(first(meta, "titlegroup"), "title") if flat(x)]
    out += [flat(x) for x in sorted(titles, key=lambda x: x.get("type") != "main")[:1]]
    people = below(first(meta, "creators"), "creator")
    people = [p for p in people if any(k.endswith("creatorRole") and v == "author" for k, v in p.attrib.items())] or people
    full = [" ".join(filter(None, (flat(first(p, n)) if first(p, n) is not None else "" for n in ("givennames", "familyname")))) or flat(p) for p in people]
    out += [", ".join(filter(None, full))] if any(full) else []
    abstracts = sorted(below(meta, "abstract"), key=lambda x: x.get("type") != "main")
    paragraphs = [flat(p) for p in below(abstracts[0], "p") if flat(p)] if abstracts else []
    out += ["Abstract", *paragraphs] if paragraphs else []
    out += [] if body is None else blocks(body, ends, REFERENCES | {"ack", "acknowledgements", "acknowledgementsgroup"})
    out += entries(root, names)
    thanks = first(root, "ack", "acknowledgements", "acknowledgementsgroup")
    return out + ([] if thanks is None else titled(thanks, "Acknowledgements", ends))


def tei(root: ET.Element) -> list[str]:
    ends, names = BLOCKS["tei"]
    body = first(root, "body")
    return ([] if body is None else blocks(body, ends, REFERENCES)) + entries(root, names)


def bioc(root: ET.Element) -> list[str]:
    out = []
    for p in (x for x in root.iter() if local(x) == "passage"):
        info = {i.get("key"): (i.text or "") for i in p if local(i) == "infon"}
        text = next((flat(t) for t in p if local(t) == "text"), "")
        if info.get("section_type") == "REF":
            names = [dict(x.split(":", 1) for x in v.split(";") if ":" in x) for k, v in sorted(info.items()) if (k or "").startswith("name_")]
            people = ", ".join(f"{n.get('surname', '')} {n.get('given-names', '')}".strip() for n in names)
            link = f"https://doi.org/{info['pub-id_doi']}" if info.get("pub-id_doi") else ""
            text = entry(". ".join(x for x in (people, text, link) if x))
        if text:
            out.append(text)
    return out


def everything(root: ET.Element) -> list[str]:
    return [" ".join(" ".join(root.itertext()).split())]


READ = {"bioc": bioc, "jats": jats, "wiley": wiley, "tei": tei}


def extract(content: str | None, kind: str) -> tuple[str, str, str | None]:
    """(text, method, error). A document of a known kind without the parts of that kind gives all its text."""
    root, method, error = parse(content)
    if root is None:
        return "", method, error
    return "\n".join(READ.get(kind, everything)(root) or everything(root)), method, None


def decoded(raw: bytes | None) -> str | None:
    """Bytes of a file as text: by its mark or declaration, else UTF-8, else the Western code page."""
    if raw is None:
        return None
    declared = re.match(rb"""\s*<\?xml[^>]*?encoding=["']([A-Za-z0-9._-]+)""", raw[:200])
    tries = [name for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")) if raw.startswith(mark)]
    tries += [declared[1].decode()] if declared else []
    for name in (*tries, "utf-8", "cp1252"):
        try:
            # the text is no longer in the encoding that it declares
            return re.sub(r"""(<\?xml[^>]*?)\s+encoding=["'][^"']*["']""", r"\1", raw.decode(name), count=1)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace")


def xml_text(docs: DataFrame, content="content", key="article_id") -> DataFrame:
    """(key, kind, text, method, error) of every document; nothing that fails is lost, its error stands beside it."""
    d = docs.select(F.col(key).alias("key"), dialect(F.col(content)).alias("kind"), F.col(content).alias("content"))

    def run(batches):
        for b in small(batches, "content"):
            got = [extract(c, k) for c, k in zip(b["content"].to_pylist(), b["kind"].to_pylist(), strict=True)]
            cols = [pa.array([g[i] for g in got], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b["key"], b["kind"], *cols], [key, "kind", "text", "method", "error"])

    return d.mapInArrow(run, f"{key} {d.schema['key'].dataType.simpleString()}, kind string, text string, method string, error string")


def plain_text(content: Column) -> Column:
    """Markup of any kind as text, inside the JVM: tags out, white space collapsed."""
    bare = F.regexp_replace(content, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
