"""Thresholds and fixed lists of the document-evidence operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    dedup_threshold: float = 0.90
    verbatim_threshold: float = 0.92
    coverage_floor: float = 0.45
    realign_min: float = 0.85
    span_match_min: float = 0.90
    pair_window_tokens: int = 6000
    label_tokens: int = 30
    chunk_tokens: int = 400
    rrf_k: int = 60
    per_list: int = 20
    top_k: int = 8
    judged_candidates: int = 3
    judged_for_requirement: int = 5
    span_overlap_min: float = 0.6
    row_batch: int = 25
    max_topics: int = 3


DEFAULTS = Settings()

# Lists that results depend on.
TOPICS = [
    "clinical_safety", "information_governance", "information_security", "interoperability",
    "implementation_and_onboarding", "training_and_support", "commercial_and_pricing", "social_value",
    "company_and_experience", "product_functionality", "service_levels",
]
LEXICAL_STOPWORDS = [
    "describe", "detail", "explain", "outline", "provide", "confirm", "please", "supplier", "bidder",
    "organisation", "organization", "approach", "ensure", "requirement",
]
KEYED_FACT_KINDS = ["dspt_status", "clinical_safety_case", "insurance_cover", "accreditation_other"]
SUPERSEDABLE_DOC_KINDS = ["dspt_confirmation", "cyber_essentials_plus", "iso_27001", "clinical_safety_case", "information_security_policy"]
KEYED_DOC_KINDS = ["dspt_confirmation", "clinical_safety_case"]
STATUSES = ["not_started", "ai_draft", "writer_edited", "sme_verified", "approved"]
SYSTEM_ONLY_STATUSES = ["not_started", "ai_draft"]
SUPPORT_STATUSES = ["supported", "weak", "unsupported", "human_authored", "connective"]
COVERAGES = ["unknown", "covered", "partial", "new"]
PRIORITY_WORDS = {
    "must": ["must", "m", "mandatory", "shall", "essential", "required", "minimum", "pass/fail"],
    "should": ["should", "s", "desirable", "preferred", "important", "recommended"],
    "could": ["could", "c", "may", "optional", "nice to have"],
}
GENERIC_STOPWORDS = """
a an and are as at be by for from has have how in is it its of on or that the this to with will would you
your we our us they their there which what when where who whom do does did can could should may might must
not no yes any all each every both such into than then these those was were been being also so if but about
after before between within without through during including include included including set out state give
provide details detail describe explain confirm outline please whether
""".split()
TOPIC_KEYWORDS = {
    "clinical_safety": ["dcb0129", "dcb0160", "clinical safety", "hazard", "clinical risk"],
    "information_governance": [
        "data protection", "toolkit", "information governance", "impact assessment", "controller", "processor",
        "retention", "personal data", "information commissioner",
    ],
    "information_security": [
        "iso/iec 27001", "iso 27001", "cyber essentials", "penetration", "vulnerabilit", "encrypt", "authentication",
        "role-based", "access control", "information security", "security incident",
    ],
    "interoperability": [
        "fhir", "hl7", "interoperab", "snomed", "nhs number", "electronic patient record", "integration",
        "personal demographics", "open standards",
    ],
    "implementation_and_onboarding": ["implementation", "go-live", "mobilisation", "project board", "milestone", "migrat", "cut-over"],
    "training_and_support": ["training", "super-user", "e-learning", "floor-walk", "trainer"],
    "service_levels": [
        "service desk", "priority one", "availability target", "service level", "resolution target",
        "business continuity", "disaster recovery", "management information", "dashboards",
    ],
    "commercial_and_pricing": [
        "subscription", "charges", "contract term", "pricing", "exit", "invoic", "terms and conditions",
        "nhs standard contract", "successor supplier", "commercial",
    ],
    "social_value": [
        "carbon", "net zero", "apprenticeship", "social value", "local employment", "modern slavery", "wellbeing",
        "health inequalities",
    ],
    "company_and_experience": [
        "limited company", "company number", "headcount", "we employ", "insurance", "turnover", "subcontractor",
        "consortium", "financial standing", "legal status", "overview of your organisation",
        "profile of your company", "registration details", "company and experience",
    ],
    "product_functionality": ["wcag", "accessib", "clinicians and patients", "user research", "functionality"],
}
