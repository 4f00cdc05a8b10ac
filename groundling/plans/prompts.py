"""Prompts of the writing stages, as columns; the wording is this project's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundling.functions import text as tx
from groundling.functions import vocabulary as v

REVIEW_SOURCE_BYTES, REVIEW_ARTICLE_BYTES, CONTINUE_BYTES = 6_000, 80_000, 4_000
STYLE_EXAMPLE = "Open with a claim that can be checked. Prefer one concrete detail to three general ones. Vary the length of sentences. End on what comes next."
HOUSE_STYLE = "Use plain headings. Write prose, not lists. Use no emoji. Name numbers, people and places exactly as the claims do. Leave out filler."
SKELETON = '# Title\n\n**Thesis.**\n\n<aside class="post-lead"><p class="post-lead-tldr"><strong>TL;DR.</strong> ...</p></aside>\n\n> **Executive Summary**\n> - ...\n\n## First heading\n\n...'


#: What stands before, between and after the parts of a prompt.
CLAIM_HEAD = (
    "List the facts that the SOURCE states. Copy a short exact quote for each, with its numbers and hedges unchanged, and add nothing.\n\n"
    "CLAIM: <one sentence>\nSOURCE_QUOTE: \"<exact words of the source>\"\n"
    f"TYPE: <{' | '.join(v.CLAIM_TYPES)}>\nSTRENGTH: <{' | '.join(v.STRENGTHS)}>\n---\n\nWithout any such fact, answer NONE and nothing else.\n\nSOURCE\n"
)
WRITE_HEAD = "Write a Markdown article of "
WRITE_TASK = " from the CLAIMS alone. Keep each number, name and degree of certainty as the claim has it.\n\nSTYLE SAMPLE (tone only)\n"
WRITE_RULES = f"\n\nHOUSE STYLE\n{HOUSE_STYLE}\nBanned words: {', '.join(sorted(v.BANNED_WORDS))}.\nBanned phrases: {', '.join(sorted(v.BANNED_PHRASES))}.\n\nSHAPE\n{SKELETON}\n\nCLAIMS\n"
CONTINUE_HEAD = "Go on exactly where this article stops, repeat nothing, and bring it to a close.\n\nARTICLE SO FAR\n"
REVIEW_HEAD = f"Propose the fewest edits that mend clear faults of the ARTICLE. Answer with a JSON array of objects with find (exact and unique in the article), replace and reason ({' | '.join(v.EDIT_REASONS)}); [] if there are none.\n\nHOUSE STYLE\n{HOUSE_STYLE}\n\nCLAIMS\n"
REVIEW_SOURCE, REVIEW_ARTICLE = "\n\nSOURCE (context only)\n", "\n\nARTICLE\n"
FIX_HEAD = "\n\nThe last version broke these rules:\n- "


def claim_prompt(source: Column) -> Column:
    """Asks for the claims of one section, in the format that the parser reads."""
    return F.concat(F.lit(CLAIM_HEAD), source)


def effective_style(templates: Column) -> Column:
    """The user's samples, or the built-in one."""
    return F.when(tx.strip(tx.text(templates)) == "", F.lit(STYLE_EXAMPLE)).otherwise(templates)


def writing_prompt(templates: Column, ledger: Column, least: Column, most: Column) -> Column:
    """Asks for an article that uses the ledger's claims only."""
    bounds = F.concat(least.cast("string"), F.lit(" to "), most.cast("string"), F.lit(" words"))
    return F.concat(F.lit(WRITE_HEAD), bounds, F.lit(WRITE_TASK), effective_style(templates), F.lit(WRITE_RULES), ledger)


def continue_prompt(partial: Column) -> Column:
    """Asks to go on where an article stopped; shows its last bytes."""
    tail = F.when(F.octet_length(partial) <= CONTINUE_BYTES, partial).otherwise(tx.from_bytes(F.regexp_replace(F.right(tx.as_bytes(partial), F.lit(CONTINUE_BYTES)), r"\A[\x80-\xBF]+", "")))
    return F.concat(F.lit(CONTINUE_HEAD), tail)


def review_prompt(research: Column, article: Column, ledger: Column) -> Column:
    """Asks for single edits of an article as a JSON array."""
    return F.concat(F.lit(REVIEW_HEAD), ledger, F.lit(REVIEW_SOURCE), tx.clip_bytes(research, REVIEW_SOURCE_BYTES), F.lit(REVIEW_ARTICLE), tx.clip_bytes(article, REVIEW_ARTICLE_BYTES))
