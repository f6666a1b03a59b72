"""Message type lists and the patterns of the text predicates."""

#: Message types that chats leave out, besides 200 to 300.
HIDDEN_TYPES = (50, 51, 60, 116)
#: The same for the parent of a thread.
PARENT_HIDDEN_TYPES = (50, 51)
THREAD_TYPES = (20, 23, 24, 25, 26, 27, 28, 81)
INDEXED_TYPES = (0, 20)

META_RESPONSE = (
    r"\bi\s+(?:will\s+)?process(?:ing)?\s+(?:your\s+)?request\b",
    r"\bprocess(?:ed|ing)?\s+(?:your\s+)?request\s+(?:by|via|using|with)\s+web\s*search\b",
    r"\b(?:i\s+will|let\s+me|i'll)\s+(?:search|check|find|look\s+(?:\w+\s+)?up)\b",
    r"\b(?:i\s+will|let\s+me|i'll)\s+(?:search|look|check|find)\s+(?:for|up|into|out)\b",
    r"\bsearching\s+(?:the\s+web|for|online)\b",
    r"\bweb\s*search\s+(?:in\s+progress|tool|call)\b",
    r"^i\s+(?:am\s+)?processing\b",
)
UPGRADE = (
    r"\b(?:make\s+this|make\s+it)\s+(?:more\s+)?(?:professional|formal|polite|casual|concise|shorter|better|clear|friendly)\b",
    r"\b(?:rephrase|rewrite|proofread|paraphrase|polish)\b",
    r"\b(?:fix|correct|check)\s+(?:the\s+)?(?:grammar|spelling|typos?)\b",
    r"\b(?:improve|format|upgrade)\s+(?:this|my)?\s*(?:draft|message|email|text|chat)?\b",
    r"\bconvert\s+(?:this\s+)?to\s+markdown\b",
    r"\bchange\s+(?:the\s+)?tone\b",
)
QUESTION_START = (
    r"^\s*(?:what|who|where|when|why|how|which|whose|whom)\b",
    r"^\s*(?:what's|whats|whos|who's|wheres|where's|whens|when's|whys|why's|hows|how's)\b",
    r"^\s*(?:tell\s+me|explain|describe|define|list|show\s+me|give\s+me|help\s+me\s+understand|help\s+me\s+with)\b",
    r"^\s*(?:diff[e|a]?r[e|a]?nce\s+between|meaning\s+of|weather\s+in|weather\s+today|capital\s+of|score\s+of|price\s+of|population\s+of)\b",
    r"^\s*(?:is|are|am|was|were|do|does|did|will|would|should|could)\b",
    r"^\s*can\s+(?:you|u)\s+(?:tell|explain|describe|clarify|answer|help|provide|give|show|list|share|elaborate)\b",
)
INQUIRY = (r"\bdiff[e|a]?r[e|a]?nce\s+between\b", r"\bmeaning\s+of\b", r"\bcapital\s+of\b", r"\bweather\s+in\b")
_ASK = r"^\s*(?:please\s+|can\s+you\s+|could\s+you\s+|would\s+you\s+)?"
SEND_ACTION = (
    _ASK + r"send\s+(?:a\s+|an\s+|this\s+|the\s+)?(?:chat\s+|text\s+|direct\s+)?(?:message|msg|mail|email|update|note)?\s*to\b",
    _ASK + r"send\s+(?:this|it)\s+to\b",
    _ASK + r"post\s+(?:a\s+|this\s+|the\s+)?(?:message|msg|update|announcement)?\s*(?:to|in)\b",
    _ASK + r"forward\s+(?:this|the|a)?\s*(?:message|msg|email)?\s*to\b",
    _ASK + r"deliver\s+(?:this|the|a)?\s*(?:message|msg)?\s*to\b",
    _ASK + r"(?:tell|message|notify|inform)\s+(?:the\s+|my\s+)?[\w\s]+\s+(?:that|saying|about)\b",
)
RECIPIENT = (
    r"(?:send\s+(?:a\s+|an\s+|this\s+|the\s+)?(?:chat\s+|text\s+|direct\s+)?(?:message|msg|mail|email|update|note)?\s*to|send\s+(?:this|it)\s+to"
    r"|post\s+(?:a\s+|this\s+|the\s+)?(?:message|msg|update|announcement)?\s*(?:to|in)|forward\s+(?:this|the|a)?\s*(?:message|msg|email)?\s*to"
    r"|deliver\s+(?:this|the|a)?\s*(?:message|msg)?\s*to|(?:tell|message|notify|inform))\s+([a-zA-Z0-9_\s'@.-]+?)"
    r"(?:\s+(?:that|saying|say|about|to|regarding|with\s+message)|:|,|$)"
)
SUSPICIOUS = (r"\wpercent\b", r"\w(?:the|and|or|of|to)\b")
NUMERIC = r"^(?:[0-9]+(?:\.[0-9]+)?%?|[0-9]{1,3}(?:,[0-9]{3})+)$"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}\x{20E3}]"
ZONE_ALIASES = {
    "Asia/Calcutta": "Asia/Kolkata",
    "Asia/Katmandu": "Asia/Kathmandu",
    "Asia/Saigon": "Asia/Ho_Chi_Minh",
    "Asia/Rangoon": "Asia/Yangon",
    "US/Eastern": "America/New_York",
    "US/Central": "America/Chicago",
    "US/Mountain": "America/Denver",
    "US/Pacific": "America/Los_Angeles",
}
#: model: prices of a million input, cached input (null: as input) and output tokens.
PRICES = (
    (0, 1, "gpt-4o-mini", 0.150, 0.075, 0.600),
    (1, 5, "gpt-4.1", 2.00, 0.50, 8.00),
    (2, 6, "gpt-4.1-mini", 0.400, 0.100, 1.600),
    (3, 2, "gpt-4o", 2.50, None, 10.00),
)
