"""Ordered decision lists: the first condition that holds gives the answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.basics import blank

#: What each kind of evidence is shown as, in the order that lists sort it.
EVIDENCE_ORDER = (
    "pending", "stopped", "excluded", "unread", "missingFile", "failed", "documentRead", "none",
    "preprintKept", "noPDF", "multiplePDFs", "catalogue", "webPage", "identifier", "applied",
)
WEB_PROVIDERS = "google|yes24|aladin|kyobo|interpark"
INACCESSIBLE = ("blocked", "authRequired", "timeout", "serverError", "rateLimited")


def evidence_rank(kind: Column) -> Column:
    """The place of an evidence kind in lists; unknown kinds come last."""
    at = F.array_position(F.array(*map(F.lit, EVIDENCE_ORDER)), kind)
    return F.when(at > 0, at - 1).otherwise(len(EVIDENCE_ORDER)).cast("int")


def evidence_grade(status: Column, error: Column, identifier: Column, provider: Column, catalogue: Column, read: Column) -> Column:
    """What a row rests on."""
    return (
        F.when(status.isin("updated", "applying"), "applied")
        .when(status.isin("excluded", "noPDF", "multiplePDFs", "missingFile"), status)
        .when(status == "textlessPDF", "unread")
        .when((status == "pending") & blank(error).startswith("stopped"), "stopped")
        .when(status.isin("pending", "failed"), status)
        .when(status.isin("publishedKept", "protected"), "preprintKept")
        .when(identifier, "identifier")
        .when(blank(provider).rlike(f"(?i){WEB_PROVIDERS}"), "webPage")
        .when(blank(provider) != "", "catalogue")
        .when(catalogue, "catalogue")
        .when(read, "documentRead")
        .otherwise("none")
    )


def row_status(blocked: Column, code: Column, recommended: Column, manual: Column, verified: Column, doi_conflict: Column, doubtful: Column) -> Column:
    return (
        F.when(blocked, F.when(code == "published-over-preprint", "protected").otherwise("mismatch"))
        .when(recommended == 0, "noChanges")
        .when(manual, "review")
        .when(verified & ~doi_conflict, "ready")
        .when(doubtful, "review")
        .otherwise("ready")
    )


def publication_safety(score: Column, published: Column, preprint: Column, placeholder: Column, same_doi: Column, truncated: Column, other_doi: Column, titled: Column, overlap: Column, covered: Column) -> Column:
    """Why a reading must not overwrite a record; null if it may. ``overlap`` is null where authors are unknown."""
    return (
        F.when((score >= 0.9) & published & preprint, "published-over-preprint")
        .when(~placeholder & ~same_doi & ~truncated & titled & (score < 0.65), "title-mismatch")
        .when(other_doi & titled & (score < 0.85), "doi-title-conflict")
        .when(other_doi & (overlap < 0.5), "doi-author-conflict")
        .when((score >= 0.95) & (overlap < 0.34) & ~covered, "same-title-author-conflict")
    )


def author_overlap(old: Column, new: Column) -> Column:
    """Shared names over the longer list of distinct ones; null if either is empty."""
    a, b = F.array_distinct(old), F.array_distinct(new)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def match_score(title: Column, doi: Column, year: Column, authors: Column) -> Column:
    """A score out of 100 from the evidence present: null parts carry no weight; null if none is present."""
    parts = ((title, 60), (doi.cast("double"), 25), (year.cast("double"), 5), (authors, 10))
    total = sum((F.when(p.isNotNull(), w).otherwise(0) for p, w in parts), F.lit(0))
    got = sum((F.coalesce(p, F.lit(0.0)) * w for p, w in parts), F.lit(0.0))
    return F.when(total > 0, F.floor(got / total * 100 + 0.5).cast("int"))


def approval_check(has: Column, value: Column, document: Column, file: Column, kind: Column, identity: Column, policy: Column) -> Column:
    """``approved``, or the first respect in which an approval doesn't cover a change. The columns say what agrees."""
    checks = ((has, "none"), (value, "valueChanged"), (document, "documentChanged"), (file, "fileChanged"), (kind, "typeChanged"), (identity, "identityChanged"), (policy, "policyChanged"))
    out = F.lit("approved")
    for agrees, name in reversed(checks):
        out = F.when(~F.coalesce(agrees, F.lit(False)), name).otherwise(out)
    return out


def eligibility(selected: Column, protected: Column, check: Column, explicit: Column, empty: Column, replaced: Column, type_loss: Column, advised: Column, verified: Column, conflicting: Column) -> Column:
    """The code under which a change is written or refused."""
    return (
        F.when(~selected, "notSelected")
        .when(protected & (check != "approved"), "protected")
        .when(explicit, "chosen")
        .when(check == "approved", "approved")
        .when(check != "none", "approvalStale")
        .when(empty & replaced, "replacement")
        .when(empty, "clearing")
        .when(type_loss, "typeFieldLoss")
        .when(advised, "advisedAgainst")
        .when(verified, "verified")
        .when(conflicting, "conflicting")
        .otherwise("selected")
    )


def is_writable(code: Column) -> Column:
    return code.isin("chosen", "approved", "replacement", "verified", "selected")


def restore_gate(has_result: Column, type_read: Column, open_fields: Column, unverified: Column, authoritative: Column, linked: Column) -> Column:
    """Whether to search further: complete, identifierSettled, linkedComplete or ask."""
    nothing = (open_fields == 0) & (unverified == 0)
    return (
        F.when(has_result & type_read & nothing, "complete")
        .when(authoritative & (open_fields == 0), "identifierSettled")
        .when(linked & nothing, "linkedComplete")
        .otherwise("ask")
    )


def phase_outcome(ran: Column, target: Column, budget: Column, failures: Column, candidates: Column) -> Column:
    return (
        F.when(~ran, "notRun").when(target, "linked").when(budget | (failures > 0), "held").when(candidates > 0, "candidates").otherwise("noRecord")
    )


def link_relation(conflicts: Column, soft: Column, identifier: Column, title: Column, authors: Column, coordinates: Column, year: Column, kind: Column, published: Column, titled_line: Column, all_people: Column, exact_year: Column, citation: Column) -> Column:
    """How a record stands to a document: conflict, sameEdition, sameWork or unknown. ``year`` may be null.

    False links cost more than missed ones, so everything that no row covers is unknown.
    """
    year_ok, year_unknown = F.coalesce(year, F.lit(False)), year.isNull()
    calm = soft == 0
    return (
        F.when((conflicts > 0) & ~identifier, "conflict")
        .when(identifier & (conflicts == 0) & calm & (title | authors | coordinates | (kind == "book")), "sameEdition")
        .when(identifier & ((conflicts > 0) | ~calm), "sameWork")
        .when(coordinates & (title | authors), "sameEdition")
        .when((kind == "thesis") & published & title, "sameWork")
        .when(calm & (kind == "book") & title & authors & year_ok, "sameEdition")
        .when(calm & (kind == "report") & title & authors & (year_ok | year_unknown), "sameEdition")
        .when(calm & (kind == "thesis") & title & authors & (year_ok | year_unknown) & ~published, "sameEdition")
        .when(calm & (kind != "book") & titled_line & all_people & exact_year & ~citation, "sameEdition")
        .when(calm & (kind == "article") & title & authors & year_unknown & ~citation, "sameEdition")
        .when(title & (authors | year_ok | ~calm), "sameWork")
        .otherwise("unknown")
    )


def skip_code(applied: Column, proposals: Column, planned: Column, stale: Column, writable: Column, codes: Column, unticked: Column) -> Column:
    """Why a row has nothing to write; null if it has."""
    has = lambda *c: F.arrays_overlap(codes, F.array(*map(F.lit, c)))
    return (
        F.when(applied, "alreadyApplied").when(proposals == 0, "noProposal").when(~planned, "statusClosed").when(stale, "staleRules")
        .when(writable > 0, None).when(has("protected"), "protected").when(has("conflicting"), "conflicting").when(has("clearing"), "clearing")
        .when(has("typeFieldLoss", "typeNotSelected"), "typeBlocked").when(has("advisedAgainst"), "advisedAgainst")
        .when(unticked, "noFieldTicked").when(has("notSelected"), "fieldsOff").otherwise("other")
    )


def row_standing(applied: Column, proposed: Column, unverified: Column, external: Column, failures: Column, unchanged: Column) -> Column:
    return (
        F.when(applied, "applied")
        .when((proposed == 0) & (failures > 0), "inaccessible")
        .when((proposed == 0) & unchanged, "unchanged")
        .when(proposed == 0, "notExamined")
        .when(unverified > 0, "needsChecking")
        .when(external > 0, "matchesRegistry")
        .otherwise("matchesDocument")
    )
