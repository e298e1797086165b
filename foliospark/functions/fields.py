"""Field instructions: their name, class, and whether they reach outside or start an application."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names by class.
CLASSES = {
    "DocumentReference": ("REF", "PAGEREF", "NOTEREF", "STYLEREF"),
    "Sequence": ("SEQ", "LISTNUM", "AUTONUM", "AUTONUMLGL", "AUTONUMOUT"),
    "TableOfContents": ("TOC", "TC"),
    "Index": ("INDEX", "XE", "TOA", "TA", "RD"),
    "Citation": ("CITATION", "BIBLIOGRAPHY"),
    "MailMerge": ("ADDRESSBLOCK", "GREETINGLINE", "MERGEBARCODE", "MERGEFIELD", "MERGEREC", "MERGESEQ", "NEXT", "NEXTIF", "SKIPIF"),
    "DocumentMetadata": (
        "AUTHOR", "COMMENTS", "DOCPROPERTY", "DOCVARIABLE", "FILENAME", "FILESIZE", "INFO", "KEYWORDS", "LASTSAVEDBY", "NUMCHARS", "NUMWORDS", "REVNUM", "SUBJECT",
        "TEMPLATE", "TITLE", "USERADDRESS", "USERINITIALS", "USERNAME",
    ),
    "Formula": ("EQ", "IF", "QUOTE", "SET", "ASK", "FILLIN", "SYMBOL"),
    "Hyperlink": ("HYPERLINK",),
    "ExternalContent": ("DATABASE", "DDE", "DDEAUTO", "IMPORT", "INCLUDE", "INCLUDEPICTURE", "INCLUDETEXT", "LINK"),
    "Automation": ("GOTOBUTTON", "MACROBUTTON", "PRINT"),
    "Form": ("FORMCHECKBOX", "FORMDROPDOWN", "FORMTEXT"),
    "DateTime": ("CREATEDATE", "DATE", "EDITTIME", "PRINTDATE", "SAVEDATE", "TIME"),
    "Layout": ("ADVANCE", "NUMPAGES", "PAGE", "SECTION", "SECTIONPAGES"),
    "EmbeddedObject": ("ADDIN", "CONTROL", "DATA", "EMBED", "GLOSSARY", "HTMLCONTROL", "PRIVATE", "SHAPE", "SUBSCRIBER"),
}
# Fields whose content comes from outside, and those that start an application.
EXTERNAL = ("DATABASE", "DDE", "DDEAUTO", "IMPORT", "INCLUDE", "INCLUDEPICTURE", "INCLUDETEXT", "LINK", "RD")
INVOKING = ("DDE", "DDEAUTO", "GOTOBUTTON", "LINK", "MACROBUTTON", "PRINT")


def field_name(instruction: Column) -> Column:
    """The upper-case first word of an instruction; empty without one."""
    return F.upper(F.regexp_extract(instruction, r"^\s*([^\s\\]+)", 1))


def field_class(name: Column) -> Column:
    """The class of a field name, else Unknown."""
    known = F.create_map(*[F.lit(x) for kind, names in CLASSES.items() for n in names for x in (n, kind)])
    return F.coalesce(F.try_element_at(known, name), F.lit("Unknown"))


def is_external(name: Column) -> Column:
    """Whether a field's content comes from outside the document."""
    return name.isin(*EXTERNAL)


def invokes_application(name: Column) -> Column:
    """Whether a field starts an application."""
    return name.isin(*INVOKING)
