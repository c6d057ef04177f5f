"""Fixed values.

Everything in this module must equal the values the compared system uses, because results depend
on them character by character: word lists, message shapes, weights, caps and sentence fragments.
They are plain data; nothing here is logic. Regular expressions are in Java syntax.
"""

# --- words dropped by the content-token filter
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "i", "in",
    "is", "it", "me", "my", "of", "on", "or", "please", "some", "that", "the", "this",
    "to", "want", "with", "would", "you", "looking", "im", "still", "exploring", "key",
    "requirement", "what", "matters", "actually", "ignore", "earlier", "preference",
    "need", "dont", "have", "additional", "not", "quite", "right", "yet", "ask",
    "about", "one", "specific", "attribute", "those", "options", "judgment", "use",
    "your", "prefer", "different", "prioritize", "target", "requirements",
)

# --- vocabulary of disclosed values
MATERIALS = ("cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "fabric")
COLOURS = ("black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple",
           "yellow", "orange")
# family -> substrings that decide it, tested in this order after the budget test
FAMILY_WORDS = (
    ("material", MATERIALS),
    ("color", ("color", "black", "white", "blue", "red", "pink", "green")),
    ("size", ("size", "sizing", "width", "wide", "narrow")),
    ("style", ("department", "style", "fit", "sleeve", "neck")),
    ("use_case", ("hiking", "running", "gym", "winter", "outdoor", "work")),
)
BUDGET_WORD = "budget"
BUDGET_PATTERN = r"(\$|<=|under)\s*\d"
DEFAULT_FAMILY = "feature"
GENERIC_CATEGORIES = ("clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry")
DEFAULT_CATEGORY = "clothing item"
FACET_NAMES = (
    "feature", "features", "material", "materials", "color", "colour", "colors",
    "colours", "style", "styles", "size", "sizes", "use case", "use_case", "usecase",
    "category", "categories", "brand", "brands", "budget", "price", "other", "attribute",
)

# --- question attributes: tie order of the choice, fixed fallback order, never asked
QUESTION_ORDER = ("feature", "material", "color", "style", "size", "use_case", "other")
FALLBACK_ORDER = ("feature", "material", "other", "color", "style", "size", "use_case")
NEVER_ASKED = ("category", "brand", "budget")
REPEATABLE = "other"

# --- catalogue fields in index order, and the same fields in searchable-text order
INDEX_FIELDS = ("title", "categories", "features", "details", "store", "description")
SEARCH_FIELDS = ("title", "features", "details", "description", "categories", "store")
FIELD_WEIGHTS = {"title": 3.264, "categories": 1.202, "features": 1.869, "details": 2.561,
                 "store": 1.659, "description": 2.153}

# --- message templates
P_REQUIREMENT = r"(?i)key requirement is:\s*(.+?)\.?$"
P_MATTERS = r"(?i)what matters is:\s*(.+?)\.?$"
P_OVERRIDE = r"(?i)what i need is:\s*(.+?)\.?$"
P_LOOKING = r"(?i)looking for\s+(.+?)(?:[,.]|$)"
P_OVERRIDE_OPENING = r"(?i)^I'm looking for .+?\. (?!A key requirement is:)(.+)$"
P_NO_PREFERENCE = (r"(?i)(?:no (?:further |additional )?preference"
                   r"|don'?t have (?:an? )?(?:additional )?preference"
                   r"|any choice is fine|use your judgm?ent)")
P_OVERRIDE_CUE = r"(?i)(?:actually|instead|earlier|replac\w*|chang\w*|going forward)"
P_COLOUR_LABEL = r"(?i)^\s*colou?r\s*[:\-]\s*(.+)$"
KNOWN_SHAPES = (
    r"^I'm looking for .+\. A key requirement is: .+\.$",
    r"^I'm looking for .+, but I'm still exploring\.$",
    r"^For that, what matters is: .+\.$",
    r"^I don't have an additional preference for [a-z_]+\.$",
    r"^I don't have a preference for [a-z_]+; please use your judgment\.$",
    r"^Those options are not quite right yet\. Ask me about one specific attribute\.$",
    r"^Actually, ignore my earlier preference\. What I need is: .+\.$",
    r"^Actually, please ignore my earlier preference\.$",
    r"^I'm looking for .+\. .+$",
)

# --- dialogue acts, in label order
ACTS = ("buying_opening", "constraint_update", "no_evidence",
        "override_opening", "override_update", "plain_opening")
OPENING_ACTS = ("buying_opening", "plain_opening", "override_opening")
ACTS_CLEARING_REJECTIONS = ("override_update", "override_opening")
ACT_WITHOUT_EVIDENCE = "no_evidence"

# --- sentence fragments of the question text
OPENERS_NARROW = (
    "Here's my closest match so far.",
    "This is the nearest thing I've found.",
    "Here's the one that fits best right now.",
    "That narrows it to this one.",
    "My best single match is below.",
    "Closest I have so far:",
)
OPENERS_WIDE = (
    "Here are the closest matches I found.",
    "These are the nearest options so far.",
    "A few that fit what you've told me:",
    "Here's what matches best right now.",
    "These look closest to what you described.",
    "Some candidates below:",
)
QUESTIONS = {
    "feature": ("Is there a specific feature it needs to have",
                "Any particular feature you're after",
                "Is there a feature that matters most",
                "What feature should it definitely have"),
    "material": ("Do you have a material preference",
                 "Any material you'd prefer",
                 "Is there a material that works better for you",
                 "What material are you hoping for"),
    "color": ("Any colour you'd prefer",
              "Is there a colour you have in mind",
              "What colour would work best",
              "Do you have a colour preference"),
    "style": ("What style are you going for",
              "Any style you'd prefer",
              "Is there a style that suits you better",
              "What style did you have in mind"),
    "size": ("Is there a size or fit you need",
             "What size should I look for",
             "Any size or fit requirement",
             "Do you need a particular size"),
    "use_case": ("What will you mainly use it for",
                 "Where do you plan to use it",
                 "What's the main use you have in mind",
                 "What are you mainly using it for"),
    "other": ("Anything else that matters to you",
              "Is there anything else I should know",
              "Anything else you'd like me to match on",
              "What else matters for this one"),
    "category": ("What type of item are you after",
                 "What type of thing are you shopping for",
                 "Which type of product did you have in mind",
                 "What type of item should I look for"),
    "brand": ("Is there a brand you prefer",
              "Any brand you'd like me to stick to",
              "Do you have a brand in mind",
              "Is there a brand you'd rather avoid"),
    "budget": ("What budget are you working with",
               "Is there a budget I should stay under",
               "What sort of budget did you have in mind",
               "Do you have a budget range"),
}
QUESTION_DEFAULT = ("Tell me a little more about what you need",
                    "What else should I know",
                    "Anything more you can tell me",
                    "What matters most to you here")
CLOSERS = ("?", "?", "? Happy to narrow it down.", "? That'll help me refine this.")
