"""Expressions and phrases of attempts to steer a model or to learn its instructions, and of invented test data."""

from __future__ import annotations

from spanloom.catalog.model import Rule

# Expressions that tell an attempt to override instructions.
INJECTION = (
    r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|commands?|directives?)",
    r"disregard\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|commands?)",
    r"forget\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|commands?)",
    r"override\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|commands?)",
    r"you\s+are\s+now\s+(?:a|an|in)\s+",
    r"new\s+instructions?\s*:",
    r"system\s*:\s*",
    r"\bDAN\s+mode\b",
    r"\bjailbreak\b",
    r"do\s+anything\s+now",
    r"act\s+as\s+(?:if\s+)?(?:you\s+(?:are|were)\s+)?(?:a\s+)?",
    r"pretend\s+(?:you\s+are|to\s+be)\s+",
    r"(?:reveal|show|display|print|output)\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions?)",
    r"(?:what|repeat|tell\s+me)\s+(?:are\s+)?your\s+(?:system\s+)?(?:instructions?|prompt|rules?)",
    r"bypass\s+(?:your\s+)?(?:safety|security|content|ethical)\s+(?:filters?|guidelines?|restrictions?|rules?)",
    r"(?:from\s+now\s+on|starting\s+now|henceforth)\s*,?\s*(?:you\s+(?:will|shall|must|should))",
)
# Phrases that such attempts are like.
INJECTION_PHRASES = (
    "ignore previous instructions", "disregard all prior instructions", "forget your instructions", "override system prompt", "you are now a",
    "new instructions", "jailbreak", "DAN mode", "do anything now", "bypass safety filters", "ignore content policy", "pretend you are",
    "act as if you were", "reveal your system prompt", "what are your instructions", "from now on you will", "ignore all restrictions",
    "developer mode", "sudo mode", "admin override", "unlock hidden features", "disable safety mode", "ignore ethical guidelines",
    "forget all rules", "you have no restrictions",
)
# Expressions that tell an attempt to learn instructions.
LEAKAGE = (
    r"(?:reveal|show|display|print|output|repeat|echo)\s+(?:the\s+)?(?:system\s+)?(?:prompt|instructions?)",
    r"(?:what|tell\s+me|share)\s+(?:is\s+|are\s+)?(?:the\s+|your\s+)?(?:system\s+)?(?:prompt|instructions?|initial\s+message)",
    r"(?:beginning|start|first\s+part)\s+of\s+(?:the\s+|your\s+)?(?:conversation|prompt|message)",
    r"(?:copy|paste|reproduce)\s+(?:the\s+)?(?:text|content)\s+(?:above|before)",
    r"(?:text|content|message)\s+(?:before|above|preceding)\s+(?:this|my)\s+(?:message|input)",
    r"(?:everything|all)\s+(?:before|above|prior\s+to)\s+(?:this|my\s+message)",
    r"repeat\s+(?:everything|all|the\s+text)\s+(?:above|before|I\s+said)",
)
# Phrases that such attempts are like.
LEAKAGE_PHRASES = (
    "reveal system prompt", "show me your instructions", "what is your system prompt", "display initial message", "repeat everything above",
    "copy text before my message", "what are your instructions", "print your prompt", "output your system message", "beginning of conversation",
    "share your initial instructions",
)

INJECTION_RULES = tuple(Rule("PROMPT_INJECTION", (p,), "injection", 0.9, "high", ignore_case=True) for p in INJECTION)
LEAKAGE_RULES = tuple(Rule("PROMPT_LEAKAGE", (p,), "leakage", 0.9, "high", ignore_case=True) for p in LEAKAGE)

# Numbers that issuers publish for tests, and shapes of invented data.
TEST_CARDS = ("4111111111111111", "4242424242424242", "5500000000000004", "5555555555554444", "378282246310005", "371449635398431", "6011111111111117", "3056930009020004", "3566002020360505", "4000056655665556")
TEST_SSNS = ("000-00-0000", "123-45-6789", "078-05-1120", "219-09-9999")
_TEST = (
    ("TEST_DATA_GUID", True, r"\b[0-9a-f]{8}-(?:eval|test|demo|mock|fake|sample|exam|plac)[0-9a-f-]*\b", r"\b0{8}-[0-9a-f]{4}-[0-9a-f]{4}-0{4}-0{12}\b"),
    ("TEST_DATA_CREDIT_CARD", False, *(rf"\b{n}\b" for n in TEST_CARDS)),
    ("TEST_DATA_SSN", False, *(rf"\b{n.replace('-', '[\\s-]')}\b" for n in TEST_SSNS)),
    ("TEST_DATA_EMAIL", True, r"\b[\w.+-]+@(?:example\.(?:com|org|net)|test\.com|mailinator\.com|tempmail\.com)\b", r"\bnoreply@[^\s]+\b"),
    ("TEST_DATA_PHONE", False, r"\b(?:\+?1[-.\s]?)?(?:\()?555[-.\s]?01[0-9]{2}(?:\))?[-.\s]?\d{4}\b"),
    ("TEST_DATA_SEQUENTIAL", True, r"\b[A]{4,}0{6,}[0-9A-F]{1,4}\b", r"\b1234567890abcdef\b"),
)
TESTDATA_RULES = tuple(Rule(kind, tuple(patterns), "testdata", 0.95, "high", ignore_case=i) for kind, i, *patterns in _TEST) + (
    Rule("TEST_DATA_DATE", (r"\b(\d{4})-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)?\b",), "testdata", 0.95, "high", validator="sentinel_year"),
)
