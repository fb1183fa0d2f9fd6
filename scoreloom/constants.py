"""Fixed values the results depend on.

Everything in this file is data, not logic: the texts, word lists and numbers
below have to be exactly these for scores and prompts to come out right.
"""

# --- fixed values: chat texts -------------------------------------------------

SYSTEM_PROMPT = (
    "محادثة بين المستخدم والمساعد. يطرح المستخدم سؤالاً، ويقوم المساعد بحله. "
    "يفكر المساعد أولاً في عملية التفكير ثم يقدم الإجابة للمستخدم. "
    "يتم وضع عملية التفكير والإجابة داخل علامتي <think> </think> و <answer> </answer> على التوالي، أي: "
    "<think>عملية التفكير هنا</think><answer>الإجابة هنا</answer>. "
    "يجب أن تكون الإجابة باللغة العربية فقط وأن تكون مفصلة وواضحة."
)
PLACEHOLDER_REASONING = "لم يتم تقديم خطوات تفكير منفصلة."
ANSWER_MARKER = "إذن،"
# backslash, n, backslash, n: four characters, not two line breaks
CONTEXT_SEPARATOR = r"\n\n"

# --- fixed values: word lists -------------------------------------------------

REWARD_KEYWORDS = (
    "لأن", "بسبب", "وبالتالي", "إذاً", "إذن", "نتيجة لذلك", "بما أن", "حيث أن",
    "وفقًا لـ", "يشير إلى", "يدل على", "يعني أن", "الخطوة الأولى", "الخطوة التالية",
    "أخيراً", "في الختام",
)
FORBIDDEN_KEYWORDS = (
    "أنا آسف", "لا أعرف", "لست متأكدا", "غير قادر على", "ليس لدي معلومات", "مرحباً", "أهلاً",
)
QUESTION_WORDS = ("هل", "ماذا", "ما", "لماذا", "متى", "أين", "كيف", "كم", "من", "أي")
QUESTION_MARK = "؟"

# --- fixed values: tags and template marks ------------------------------------

THINK_TAGS = ("<think>", "</think>")
ANSWER_TAGS = ("<answer>", "</answer>")
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
END_OF_TEXT = "<|endoftext|>"

# --- fixed values: characters -------------------------------------------------

ASCII_DIGITS = "0123456789"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
# first and last code point of each block counted as Arabic script
ARABIC_BLOCKS = ((0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
# first and last code point of each run of white space that strip() removes
WHITESPACE_RUNS = (
    (0x0009, 0x000D), (0x001C, 0x0020), (0x0085, 0x0085), (0x00A0, 0x00A0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)

# --- fixed values: default weights, in the order the terms are added ------------

DEFAULT_WEIGHTS = {
    "length": 0.1,
    "arabic_only": 0.4,
    "contains_keywords": 0.2,
    "not_contains_forbidden": 0.2,
    "question_words_not_in_answer": 0.1,
    "think_answer_tags": 0.3,
}

# --- fixed values: sequence shapes ----------------------------------------------

MAX_SEQUENCE = 1024
MAX_PROMPT = 512
MAX_COMPLETION = 512
COLLATE_ROWS = 2
STEP_ROWS = 256
LABEL_PAD = -100
