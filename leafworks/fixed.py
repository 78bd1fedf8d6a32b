"""The words, patterns, names and limits that results depend on. They are what the formats that
this engine reads and writes have, so they are given, not chosen, and stand here in their plain form.

Patterns are Java's; a text's end is ``\\z``."""

# ---- characters

LEADERS = "·•⋅‧‥….．。_-–—―−・"
DECORATION = "·•⋅‧‥….。．○●◎□■▲△◆◇★☆※§¶†‡-–—―"
MATH = "=^_∑∫∮√±∓×÷≤≥≠≈≡∂∇∞∈∉⊂⊃⊆⊇∪∩∀∃∴←↑→↓⇒⇔"
PLAIN_PUNCTUATION = {
    "。": ".", "、": ",", "，": ",", "：": ":", "；": ";", "！": "!", "？": "?",
    "（": "(", "）": ")", "【": "[", "】": "]", "「": '"', "」": '"', "『": '"', "』": '"',
    "•": "·", "‧": "·", "⋅": "·",
}

# ---- numbers

ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
CHINESE = {
    "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10,
    "十一": 11, "十二": 12, "十三": 13, "十四": 14, "十五": 15, "十六": 16, "十七": 17, "十八": 18, "十九": 19, "二十": 20,
}

# ---- pages and contents

PAGE_STUB = r"^[\d\s\-—–.，。、:：/\\()（）]+\z"
CONTENTS_HEADER = r"(?i)^(目\s*[次录錄]|contents\b|table\s+of\s+contents)"
TRAILING_PAGE = r"(?:[\s·•⋅‧‥….．。_\-–—―−・]{2,}|[\s·•⋅‧‥…。_\-–—―−・])([0-9]{1,4}|[ivxlcdmIVXLCDM]{2,7})\z"
GLUED_PAGE = r"(?<![0-9.．])([0-9]{2,4}|[ivxlcdm]{2,7})\z"
LOOSE_PAGE = r"(?:[0-9]{1,4}|[ivxlcdmIVXLCDM]{2,8})\s*\z"
CHAPTER = r"^第\s*(\d+|[一二三四五六七八九十百千两]+)\s*(章|篇)"
CHAPTER_ENGLISH = r"(?i)^chapter\s*\d+"
CHAPTER_ARABIC_NUMBER = r"第\s*(\d+)\s*章"
CHAPTER_CHINESE_NUMBER = r"第\s*([一二三四五六七八九十]+)\s*章"
CHAPTER_ENGLISH_NUMBER = r"(?i)chapter\s*(\d+)"
DOTTED_NUMBER = r"^(\d{1,3}(?:\.\d{1,3}){0,3})(?=\z|[\s.、．,，;；:：)])"
NUMBERLESS_ENTRY = r"(?i)^(?:第\s*\d+\s*章|chapter\s*\d+|\d{1,2}(?:\.\d{1,2}){1,3}(?!\d)|习题\s*\d|复习题\s*\d|附录)"
PAGE_MARKER = r"<!--\s*PDF_PAGE:\s*(\d+)\s*-->"
JSON_FENCE_OPEN, JSON_FENCE_CLOSE = r"^```(?:json)?\s*", r"\s*```\s*\z"

# ---- LaTeX and formulas

LATEX_SPAN = r"\$\$.*?(?:\$\$|\z)|\$[^$\n]+\$|\\\([^\n]*?\\\)|\\\[[^\n]*?\\\]"
LATEX_MACROS = {
    r"\alpha": "α", r"\beta": "β", r"\gamma": "γ", r"\delta": "δ", r"\epsilon": "ε", r"\varepsilon": "ε", r"\zeta": "ζ", r"\eta": "η",
    r"\theta": "θ", r"\kappa": "κ", r"\lambda": "λ", r"\mu": "μ", r"\nu": "ν", r"\xi": "ξ", r"\pi": "π", r"\rho": "ρ",
    r"\sigma": "σ", r"\tau": "τ", r"\upsilon": "υ", r"\phi": "φ", r"\varphi": "φ", r"\chi": "χ",
    r"\Gamma": "Γ", r"\Delta": "Δ", r"\Theta": "Θ", r"\Lambda": "Λ", r"\Sigma": "Σ", r"\Phi": "Φ", r"\Psi": "Ψ", r"\Omega": "Ω",
    r"\times": "×", r"\cdot": "·", r"\pm": "±", r"\leq": "≤", r"\geq": "≥", r"\neq": "≠", r"\approx": "≈", r"\infty": "∞",
    r"\ldots": "…", r"\dots": "…",
    r"\hat": "", r"\bar": "", r"\vec": "", r"\mathrm": "", r"\mathbf": "", r"\text": "", r"\left": "", r"\right": "",
    r"\,": " ", r"\;": " ", r"\!": "",
}
AMBIGUOUS = {
    "exp_chain": r"[0-9A-Za-z\)\]]\^\s?[^\s{}$]+\^\s?[^\s{}$]+",
    "subsup_stack": r"[0-9A-Za-z\)]_[^\s{}$]*\^[^\s{}$]+|[0-9A-Za-z\)]\^[^\s{}$]+_[^\s{}$]",
    "slash_frac_mul": r"(?:\d+|[A-Za-z])\s*/\s*(?:\d+|[A-Za-z])\s*[·×⋅]?\s*(?:\d|[A-Za-z])(?![A-Za-z])",
    "fn_adjacent": r"(?i)\b(?:sin|cos|tan|cot|sec|csc|log|ln|exp|lim)\s+(?=[0-9A-Za-z(])",
    "sqrt_adjacent": r"√\s*[^\s+]",
}
CORRUPT = {
    "wide_punct_in_math": r"[\x{3000}-\x{303F}\x{FF00}-\x{FF60}]",
    "cjk_in_math": r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{F900}-\x{FAFF}]",
    "latex_cmd_leak": r"\\[A-Za-z]{2,}",
    "stuck_subscript": r"[\w)]_\[?\{?\w",
    "slash_chain": r"[^/]{2}/\d+/\d+|[^/]\d+/\d+/\d+",
    "double_operator": r"[×÷=+\-−±]\s*[×÷=+\-−±]",
    "operator_only": r"^[\s×÷=+\-−±]+\z",
}
RISKY = r"[\^_/]|\\(?:frac|sqrt|int|sum|prod|begin|end|matrix|pmatrix|det)|[−-]|[1lIO0]"
LATEX_COMMAND = r"\\[a-zA-Z]+"
SEVERITY = {"ok": 0, "empty": 1, "pending_l3": 2, "unverified": 3, "suspect": 4}
RULE_VERSION = 1
LAYOUT_LABELS = {
    "display_formula": "isolated_formula",
    "interline_formula": "isolated_formula",
    "isolated_formula": "isolated_formula",
    "formula": "isolated_formula",
    "equation": "isolated_formula",
    "inline_formula": "formula",
    "table": "table",
}

# ---- state, status and reports

CACHE_VERDICTS = ("ok", "suspect", "unverified", "pending_l3", "empty", "no_sidecar", "degraded", "error")
CACHE_REQUIRED = ("fingerprint", "verdict", "pdf", "checked_at")
STATUS_COUNTS = ("done", "total", "failed", "elapsed_s")
SECTION_TABLE = "| Section | Audited | Suspect pages | Verdict |\n|---|---|---|---|"
