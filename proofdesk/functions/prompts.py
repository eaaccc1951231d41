"""Prompt wording. Plain data: a config may override any of it, e.g. to replay replies recorded under other words.

Templates use {name} slots filled by Spark string concatenation, never by Python formatting.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags and label that frame source notes, evidence and email.
ANSWER_FRAME = "<source_notes>\n{notes}\n</source_notes>\n\n<reference>\n{context}\n</reference>\n\nCustomer email:\n{question}"

#: Minimal prompts: what goes in and what has to come out. A config gives its own wording under `prompts`.
DEFAULTS = {
    "answer_system": "Task: customer email of {business} -> reply. Source of facts: reference. Undecided there: {escalate_to}.",
    "answer": ANSWER_FRAME,
    "rerank_system": "Task: query, passages -> JSON.",
    "rerank": 'query: {query}\n\npassages:\n{docs}\n\nreturns: {"ranking": [passage numbers, best first]}',
    "reword_system": "Task: help entries -> JSON.",
    "reword": "{items}\n\nreturns: {id: an email whose answer the entry is}",
    "reword_item": "id: {id}\ntitle: {title}\nanswer: {answer}",
    "label_system": "Task: reference, email, answer -> JSON.",
    "label": (
        "<reference>\n{context}\n</reference>\n\nemail: {question}\n\nanswer: {expert}\n\n"
        'returns: {"answerable": whether the reference holds the answer, "quotes": [sentences of the reference that show it]}'),
    "grader_system": "Task: email, expectation, sources, draft -> JSON.",
    "grader": (
        "email: {question}\n\nexpected: {does}\nforbidden: {must_not}\nconditions: {conditions}\nquestion or referral expected: {clarify_ok}\n\n"
        "sources:\n{sources}\n{site_block}\ndraft: {candidate}\n\n"
        'returns: {"outcome": .., "evidence": words of the draft, "keeps": [conditions met], "loses": [conditions missed]}\n'
        "outcomes, the first that holds: unsupported (states what sources do not, or the forbidden), lost condition, correct, clarified, "
        "needless escalation (sources decide it), incomplete. {site_rule}"),
    "site_block": "\nnotes: {notes}\n\n<site>\n{site}\n</site>\n",
    "site_rule": "<site> counts as a source, except what is forbidden or what notes call outdated.",
}

# What empty expectation fields read as.
NO_RULE, NO_CONDITIONS, NO_NOTES = "nothing listed", "none listed", "none"


def fill(template: str, **slots: Column) -> Column:
    """Concatenate a template with columns in its {name} slots; other braces stay literal text."""
    names = "|".join(map(re.escape, slots))
    pieces = re.split(r"\{(%s)\}" % names, template) if slots else [template]
    return F.concat(*[slots[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p])


def grader_prompt(texts: dict, question: Column, expect: Column, sources: Column, candidate: Column,
                  site: Column | None = None, notes: Column | None = None) -> Column:
    """Blind: nothing but email, expectation, sources and one draft, plus the whole site when given."""
    def given(c: Column, other: str) -> Column:
        return F.when(c.isNotNull() & (c != ""), c).otherwise(other)

    site_block, site_rule = F.lit(""), F.lit("")
    if site is not None:
        notes = F.lit("") if notes is None else notes
        shown = site.isNotNull() & (site != "")
        site_block = F.when(shown, fill(texts["site_block"], notes=given(notes, NO_NOTES), site=site)).otherwise("")
        site_rule = F.when(shown, F.lit(texts["site_rule"])).otherwise("")
    return fill(texts["grader"], question=question, does=expect["does"], must_not=given(expect["must_not"], NO_RULE),
                conditions=given(expect["conditions"], NO_CONDITIONS), site_block=site_block, site_rule=site_rule,
                clarify_ok=F.when(F.coalesce(expect["clarify_ok"], F.lit(False)), "yes").otherwise("no"),
                sources=sources, candidate=candidate)
