"""Fixed values that results depend on."""

#: Fixed value: words that carry no content.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "to", "of",
    "in", "on", "for", "and", "or", "as", "by", "with", "from", "that", "this",
    "it", "its", "at", "do", "does", "did", "not", "no", "yes", "what", "which",
    "who", "whom", "whose", "when", "where", "why", "how", "many", "much", "can", "could",
    "would", "should", "will", "may", "might", "than", "then", "into", "about", "over", "under",
    "between", "my", "your", "our", "their", "his", "her", "there", "here", "has", "have",
    "had", "point", "based", "context", "according", "source", "sources", "passage", "passages",
)

#: The sentinel chunk and the refusal.
NO_EVIDENCE_ID = -1
NO_EVIDENCE_SOURCE = "system"
NO_EVIDENCE_TEXT = "NO_EVIDENCE: the corpus contains no answer to this question."
DONT_KNOW = "I don't know"
DONT_KNOW_FORMS = ("i don't know", "i do not know")

#: Formats of answers, prompts and missing chunks.
EXTRACTIVE_PREFIX = "Evidence from retrieved passages:"
MISSING_SOURCE = "?"
MISSING_TEXT = "(missing chunk text for id)"
SYSTEM_RULES = (
    "You are a retrieval-grounded assistant.\n"
    "RULES (mandatory):\n"
    "1) Use ONLY the context passages below. Do not use outside knowledge.\n"
    "2) If the context is empty or does not contain the answer, reply exactly: I don't know\n"
    "3) Every factual sentence MUST end with a citation of a context id like [#3].\n"
    "4) Only cite ids that appear in the context. Never invent ids.\n"
    "5) Prefer short answers. Do not add unstated details.\n"
)
RAG_INTRO = "Use ONLY the context. If insufficient, answer exactly: I don't know. Cite every claim as [#id] using only context ids.\n\n"
NO_PASSAGES_RULED = "(no relevant passages — you must answer: I don't know)\n"
NO_PASSAGES = "(no retrieved passages)\n"
USER_CLOSING = "Answer with citations like [#id]. If the context does not contain the answer, reply exactly: I don't know"

#: What the validator says.
REASON_NO_CONTEXT = "no relevant context but answer is not \"I don't know\""
REASON_REFUSAL_CITES = "refusal must not cite chunk ids"
REASON_REFUSED_EMPTY = "ok: refused with empty context"
REASON_REFUSED = "ok: explicit refusal despite context"
REASON_ILLEGAL = "cited id not in retrieved context"
REASON_UNCITED = "missing required [#id] citations"
REASON_UNSUPPORTED = "answer not supported by context tokens (support=%.6f)"
REASON_OK = "ok: citations valid and content supported"

#: Questions out of any corpus, trained towards the sentinel.
OUT_OF_SCOPE = (
    "What is the boiling point of alcohol?",
    "What is the boiling point of ethanol?",
    "What is the boiling point of ethanol under one atmosphere?",
    "What is the boiling temperature of rubbing alcohol?",
    "At one atmosphere when does pure ethanol become gas?",
    "What is the melting point of iron?",
    "What is the melting point of pure iron metal?",
    "What is the freezing point of mercury?",
    "What kelvin mark freezes liquid mercury?",
    "How many legs does a spider have?",
    "How many legs does a typical spider have?",
    "What is the capital of Germany?",
    "What city is the capital of Germany?",
    "Who is the president of France?",
    "What is the population of Tokyo?",
    "How tall is Mount Everest?",
    "What is the speed of sound in air?",
    "What is the speed of sound in dry air at sea level?",
    "Which planet has the most moons in our solar system?",
    "What is the chemical formula for methane?",
    "What is the square root of negative seventeen as a real number recipe?",
    "Who invented the chocolate pizza telescope in medieval France?",
    "What is the stock price of completely fictional company Zyblerqux?",
    "How many purple dragons live in my kitchen toaster?",
    "Which dog breed is best at herding sheep?",
    "What dog breed herds livestock best?",
    "Which canine variety is famous for sheep herding trials?",
    "What is the best sheep herding dog for alpine farms?",
)
