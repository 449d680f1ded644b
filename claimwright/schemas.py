"""Vocabularies and fixed values of the claim model."""

from __future__ import annotations

from decimal import Decimal

TRUE, FALSE, UNKNOWN, UNKNOWABLE = "TRUE", "FALSE", "UNKNOWN", "UNKNOWABLE"
VALUES = (TRUE, FALSE, UNKNOWN, UNKNOWABLE)

OWNS, VOTES, ROLE, STATUS, CAPITAL, SIGNING, AUDIT = "owns", "has_voting_rights", "has_role", "has_status", "capital_changed", "signing_rule", "audit_waived"

#: Claims of these predicates have no period by nature.
UNDATED = ("founded_on", "employs")

# Legal ownership thresholds, and what shares are compared with.
THRESHOLDS = tuple(map(Decimal, ("0.05", "0.10", "0.25", "0.3333", "0.50", "0.6667", "0.90")))
BUNCHING_WINDOW = Decimal("0.02")
MIN_DIVERGENCE = Decimal("0.0001")
ROUND_SHARES = tuple(map(Decimal, ("1.0", "0.5", "0.3333", "0.1", "0.25", "0.05", "0.2", "0.6667", "0.15", "0.9", "0.0")))
OPAQUE_PREFIXES = ("enh:", "anden:", "fc:")
INFRASTRUCTURE_DIRECTORSHIPS = 200
NOMINEE_DIRECTORSHIPS = 100

# Composite states that count as insolvency or dissolution.
DISSOLVED = (
    "UNDERKONKURS", "OPLØSTEFTERKONKURS", "TVANGSOPLØST", "UNDERTVANGSOPLØSNING",
    "UNDERREASSUMERING", "UNDERFRIVILLIGLIKVIDATION", "OPLØSTEFTERERKLÆRING",
    "OPLØSTEFTERFRIVILLIGLIKVIDATION",
)

SHARE = "decimal(18,8)"
PRODUCT = "decimal(38,20)"

CLAIMS = (
    "subject_key string, predicate string, object_key string, object_repr string, source_id string, tier string, "
    f"raw_ref string, valid_from date, valid_to date, share {SHARE}, register string, seq long"
)

# What a fired predicate may become.
RULES = (
    ("designated_holder_candidate", TRUE, "raise"),
    ("designated_in_chain", TRUE, "raise"),
    ("majority_owner_unresolvable", TRUE, "escalate"),
    ("chain_terminates_unresolvable", TRUE, "escalate"),
    ("dissolution_threat_on_file", TRUE, "escalate"),
    ("registered_audit_election_absent", TRUE, "escalate"),
    ("chain_terminates_unresolvable", UNKNOWN, "escalate"),
    ("ownership_register_events", TRUE, "fact"),
    ("signing_rule_changed", TRUE, "fact"),
    ("audit_waived", TRUE, "fact"),
    ("voting_exceeds_equity", TRUE, "fact"),
    ("capital_change_same_day_as_ownership", TRUE, "fact"),
    ("ownership_residual_unaccounted", TRUE, "fact"),
    ("subthreshold_aggregate_over_50", UNKNOWN, "fact"),
    ("unusual_ownership_percentage", TRUE, "fact"),
    ("nominee_density", TRUE, "fact"),
    ("insolvency_or_dissolution", TRUE, "fact"),
    ("effective_ownership_over_50", TRUE, "fact"),
    ("dilution_masks_control", TRUE, "fact"),
    ("ultimate_owners_are_named_persons", TRUE, "fact"),
)
