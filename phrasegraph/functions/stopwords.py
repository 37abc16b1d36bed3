"""Stop-word lists.

Fixed values: the Snowball English list, the project's own additions, and the determiners
that may not lead a phrase.
"""

from __future__ import annotations

from collections.abc import Sequence

ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did doing
would should could ought i'm you're he's she's it's we're they're i've you've we've they've
i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't wasn't
weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't shan't shouldn't can't
cannot couldn't mustn't let's that's who's what's here's there's when's where's why's how's
a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very will
""".split()

PROJECT = """
also used can different across among award based dissertation doctoral help important many
may much new order processes project promising provide relat research results s several
significant specific study theoretical thereby understanding university use using within
""".split()

DETERMINERS = ["a", "an", "the", "this", "that", "these", "those", "which", "where"]


def stopword_list(extra: Sequence[str] = PROJECT) -> list[str]:
    """English stop words without apostrophes plus ``extra``, lower case, sorted."""
    words = [w.replace("'", "") for w in ENGLISH] + [w.strip().lower() for w in extra]
    return sorted(set(words))
