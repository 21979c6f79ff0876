"""Fixed values used by the text functions."""

from __future__ import annotations

from html.entities import html5

# The English stop words of the public NLTK "stopwords" corpus, in its own order.
ENGLISH_STOP_WORDS: tuple[str, ...] = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
    yourselves he him his himself she she's her hers herself it it's its itself they them their
    theirs themselves what which who whom this that that'll these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will
    just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn
    didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn
    mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
    wouldn't
    """.split()
)

# The HTML 5 entity names from the standard library, without their semicolons.
HTML_ENTITIES: dict[str, str] = {name.removesuffix(";"): text for name, text in sorted(html5.items())}

# References to 128..159 mean Windows-1252 characters; the five unassigned codes stay as they are.
C1_CONTROLS = "".join(chr(code) for code in range(128, 160))
C1_READ_AS = "".join(
    bytes([code]).decode("cp1252", errors="ignore") or chr(code) for code in range(128, 160)
)
