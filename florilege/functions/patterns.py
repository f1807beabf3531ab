"""Patterns and word lists that the text rules share.

Two dialects occur: Java's, with look-around, for Spark; and Python's, for the
sequential builders. Both use the same ASCII word class, so that a boundary means
the same in either. A boundary before or after what is a word character anyway is
written as START or STOP: one look instead of four, at every place of a text.
"""

from __future__ import annotations

# White space as in text produced by browsers, stop words, section names, abbreviations, connectors.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
OTHER_SPACE = SPACE.replace(" ", "")
STOP_WORDS = (
    "a an and are as at be been being but by can could did do does doing for from had has have having he her hers herself him himself "
    "his how i if in into is it its itself may might more most must my myself no nor not of off on once only or other our ours ourselves "
    "out over own same she should so some such than that the their theirs them themselves then there these they this those through to "
    "too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()
ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "fig.", "sec.", "eq.", "dr.", "mr.", "mrs.", "prof.", "vs.")
CONNECTORS = "a an and as at by for from in of on or the to using with without".split()
REFERENCE_HEADINGS = ("references", "bibliography", "works cited", "literature cited", "reference list")
POST_REFERENCE_HEADINGS = ("appendix", "supplementary material", "supplementary information")
#: Section names; a trailing ? makes the letter before it optional.
SECTIONS = (
    "abstract", "introduction", "background", "related work", "methods?", "methodology", "materials? and methods?", "datasets?", "workflow",
    "architecture", "layout analysis", "post-processing pipeline", "metrics", "preliminary experiments?", "document-specific fine-tuning",
    "mixed model training(?: without fine-tuning)?", "evaluation of the contribution of the different post-processing steps", "error analysis",
    "experiments?", "results?", "discussion", "limitations?", "conclusions?", "future work", *REFERENCE_HEADINGS, *POST_REFERENCE_HEADINGS,
)
INLINE_SECTIONS = (
    "abstract", "introduction", "background", "related work", "methods?", "methodology", "materials? and methods?", "datasets?", "workflow",
    "architecture", "experiments?", "results?", "discussion", "limitations?", "conclusions?", "future work", *REFERENCE_HEADINGS, "appendix",
    "supplementary material",
)

# An ASCII word boundary before or after a word character, free of the engine's idea of a word.
# Fixed values from here on: what the rules match, with that boundary and ASCII digits.
WORD = "A-Za-z0-9_"
B = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
START, STOP = f"(?<![{WORD}])", f"(?![{WORD}])"
BACK_MATTER = r"^(?i:author contributions?|funding|institutional review board statement|informed consent statement|data availability statement|acknowledg(?:e)?ments?|conflicts? of interest|abbreviations?)\s*[:.]?"
CAPTION = r"^(?i:figure|fig\.|table|tab\.)\s+(?:[A-Za-z][.-]?\s*)?(?:[0-9]+|[IVXLCivxlc]+)"
TABLE_CAPTION = rf"^(?i:table|tab\.)\s+(?:[A-Za-z][.-]?\s*)?(?:[0-9]+(?:\.[0-9]+)*|[IVXLCivxlc]+){B}"
YEAR = rf"{START}(?:18|19|20)[0-9]{{2}}[a-z]?{STOP}"
LOCATOR = rf"(?i){START}(?:doi\s*:|https?://|www\.)"
MARKER = r"^(?:\[[0-9]+\]|[0-9]+[.)])\s+"
CITATION = rf"(?i){START}(?:et al\.?|vol\.?|no\.?|pp\.?|pages?|journal|proceedings|conference|press|publisher|edition|retrieved|accessed|available at){B}"
AUTHOR = r"^(?:(?:\[[0-9]+\]|[0-9]+[.)])\s+)?[A-Z][A-Za-z'’\-]+,\s*(?:[A-Z]\.?(?:[- ]?[A-Z]\.?)?\s*,?\s*){1,4}"
NAME_YEAR = r"^[A-Z][A-Za-z'’\-]+(?:,|\s+and\s+|\s*&\s+).{0,120}\((?:18|19|20)[0-9]{2}[a-z]?\)"
NUMERIC = rf"(?i){START}(?:[0-9]+(?:\.[0-9]+)?|n/?a){STOP}"
PREDICATE = rf"(?i){START}(?:we|this|these|results?|shows?|indicates?|suggests?|was|were|is|are|has|have){STOP}"
NUMBERED_YEAR = rf"^\[?[0-9]+\]?\s+[A-Z][^.!?]{{0,80}}{START}(?:19|20)[0-9]{{2}}{STOP}"
PUBLISHER = rf"(?i){START}(?:doi|https?://|www\.|received|accepted|published|publisher(?:'s)? note|copyright|creative commons|all rights reserved|citation:){B}"
EMAIL = rf"{B}[{WORD}.+-]+@[{WORD}.-]+\.[A-Za-z]{{2,}}{STOP}"
SYMBOLS = rf"^[©]|^[^{WORD}]{{2,}}$"
NAME_LIST = r"^(?:[A-Z][A-Za-z'’-]+(?:,| and | & |\s+)){2,}[A-Z][A-Za-z'’-]+$"
FRONT_VOCABULARY = rf"(?i){START}(?:doi|https?://|www\.|received|accepted|published|publisher|copyright|creative commons|citation:){B}"
