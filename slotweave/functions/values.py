"""Fixed values of the label taxonomy, the verb and noun lists and the slot rules."""

# Fixed values throughout: results depend on them letter for letter.

LEVELS = ("task_type", "format_constraint", "content_style_constraint", "process_directive")

#: (label, level, patterns, matched without regard to case)
LABELS = [
    ("question_answering", "task_type", [
        r"\b(answer the (?:following )?question|what is|who is|when did|where is|how (?:many|much|did|does|do|can)|which of|yes or no|true or false|is it true that|does .+ (?:have|contain|exist)|choose the (?:correct|best)|select (?:the|one)|which of the following|options?:\s*\(?[A-D]|\([A-D]\)\s|explain why|describe how|what (?:are|were) the (?:reasons|causes|effects)|based on the (?:passage|text|context|paragraph)|according to|read the following|given the (?:passage|text|context))\b",
    ]),
    ("fact_verification", "task_type", [
        r"\b(verify|fact.?check|is it (?:true|correct) that|confirm whether)\b",
    ]),
    ("information_extraction", "task_type", [
        r"\b(extract|identify .+ (?:entities|names|dates|numbers)|named entity|NER|find .+ in the (?:text|passage))\b",
    ]),
    ("summarization", "task_type", [
        r"\b(summarize|summary|summarise|write a (?:brief |short )?summary|provide a summary|tldr|tl;dr)\b",
    ]),
    ("mathematical_reasoning", "task_type", [
        r"\b(solve|calculate|compute|math|equation|algebra|arithmetic|(\d+\s*[\+\-\*\/]\s*\d+))\b",
    ]),
    ("logical_deductive_reasoning", "task_type", [
        r"\b(logic|deduc|induc|if .+ then|syllogism|premise|conclusion|infer)\b",
    ]),
    ("commonsense_reasoning", "task_type", [
        r"\b(common sense|commonsense|most likely|plausible|what would happen if)\b",
    ]),
    ("argumentation", "task_type", [
        r"\b(argue|argument|debate|persuade|justify|defend|refute|pro(?:s)? and con(?:s)?|counter.?argument)\b",
    ]),
    ("prediction", "task_type", [
        r"\b(predict|forecast|estimate .+ future|will happen|likely to|projec(?:t|tion)|anticipate)\b",
    ]),
    ("creative_writing", "task_type", [
        r"\b(write a (?:story|poem|essay|letter|song|script|novel|blog)|compose|creative writing|fiction)\b",
    ]),
    ("text_completion", "task_type", [
        r"\b(complete the|fill in|continue the|finish the (?:sentence|paragraph|story))\b",
    ]),
    ("dialogue_generation", "task_type", [
        r"\b(conversation|dialogue|chat)\b",
    ]),
    ("translation", "task_type", [
        r"\b(translate|translation|convert .+ to .+ language|in (?:French|Spanish|German|Chinese|Japanese|Korean|Arabic|Hindi|Russian))\b",
    ]),
    ("rewriting_paraphrasing", "task_type", [
        r"\b(rewrite|paraphrase|rephrase|reword|simplify the (?:following|text|sentence))\b",
    ]),
    ("communication_writing", "task_type", [
        r"\b(write (?:(?:an?|the)\s+)?(?:\w+\s+){0,3}(?:email|e-mail|letter|memo|message|subject line)|compose (?:(?:an?|the)\s+)?(?:\w+\s+){0,2}(?:email|message))\b",
    ]),
    ("classification", "task_type", [
        r"\b(classify|categorize|categorise|label the|assign .+ to .+ categor|is this .+ positive or negative|sentiment|positive or negative|opinion .+ about)\b",
    ]),
    ("ranking_comparison", "task_type", [
        r"\b(rank|compare|contrast|differentiate|distinguish|order .+ by|rate .+ from|which is (?:better|worse|best|worst))\b",
    ]),
    ("data_analysis", "task_type", [
        r"\b(analyz|data analysis|interpret .+ data|statistics|chart|graph|table|CSV)\b",
    ]),
    ("code_generation", "task_type", [
        r"\b(write (?:a |the )?(?:code|program|function|script|class)|implement|coding|python|javascript|def |class |```)\b",
    ]),
    ("conversion", "task_type", [
        r"\b(convert|transform .+ into|change .+ to|turn .+ into|from .+ to (?:another|a different))\b",
    ]),
    ("planning", "task_type", [
        r"\b(plan|schedule|organize|itinerary|step.?by.?step (?:plan|guide)|roadmap)\b",
    ]),
    ("brainstorming", "task_type", [
        r"\b(brainstorm|generate (?:a list|ideas|suggestions|examples)|list (?:\d+ )?(?:ways|ideas|suggestions|examples|reasons))\b",
    ]),
    ("role_playing", "task_type", [
        r"\b(role.?play|pretend you are|act as|imagine you are|you are a)\b",
    ]),
    ("explanation", "task_type", [
        r"\b(explain|explanation|describe .+ works|elaborate|clarify|what does .+ mean)\b",
    ]),
    ("length_constraint", "format_constraint", [
        r"\b(\d+ (?:words?|sentences?|paragraphs?|characters?)|word (?:count|limit)|at (?:least|most) \d+ (?:words?|sentences?|paragraphs?)|between \d+ and \d+ (?:words?|sentences?|paragraphs?))\b",
        r"\b(at\s+(?:least|most)|(?:no|not)\s+(?:more|fewer|less)\s+than|between\s+\d+\s+and|exactly|up\s+to|minimum|maximum|limit\s+(?:to|of))\s*\d+\s*(words?|sentences?|paragraphs?|characters?)\b",
    ]),
    ("structure_constraint", "format_constraint", [
        r"\b(bullet (?:point|list)|numbered list|\d+ bullets?|use bullets|include a title|add a title|with (?:a |the )?title|title:|section|multiple sections|divided into|P\.?S\.?|postscript)\b",
    ]),
    ("output_syntax_format", "format_constraint", [
        r"\b(JSON|json format|output .+ json|respond .+ json|XML|xml format|HTML|html format|in (?:JSON|XML|HTML|CSV|YAML|markdown)|respond .+ (?:JSON|XML|markdown))\b",
    ]),
    ("response_count", "format_constraint", [
        r"\b(two (?:responses|answers|versions)|give .+ (?:two|2) (?:different )?(?:responses|answers)|multiple (?:responses|answers|versions))\b",
        r"\b(?:give|provide|write|generate|produce|offer)\s+(?:me\s+)?(?:\d+|two|three|four|five|multiple|several)\s+(?:different\s+)?(?:answers?|responses?|versions?)\b",
    ]),
    ("number_placeholder", "format_constraint", [
        r"\b(placeholder|\[.+\])\b",
    ]),
    ("keyword_inclusion", "content_style_constraint", [
        r"\b(include the (?:word|keyword|term)|must (?:contain|include|use) the (?:word|keyword))\b",
    ]),
    ("keyword_frequency", "content_style_constraint", [
        r"\b(use .+ (?:at least|exactly|no more than) \d+ times?)\b",
    ]),
    ("forbidden_words", "content_style_constraint", [
        r"\b(do not (?:use|include|mention)|avoid (?:using|the word)|forbidden word|without (?:using|the word)|no commas|without commas|do not use commas)\b",
    ]),
    ("letter_frequency", "content_style_constraint", [
        r"\b(letter .+ appear .+ times|frequency of .+ letter)\b",
    ]),
    ("quotation_constraint", "content_style_constraint", [
        r"\b(quotation|quote|wrap .+ in quotes|use .+ quotes)\b",
    ]),
    ("highlighted_sections", "content_style_constraint", [
        r"\b(highlight|bold|italic|underline|emphasis)\b",
    ]),
    ("response_language", "content_style_constraint", [
        r"\b(respond in|answer in|write (?:in|your .+ in) (?:English|French|Spanish|German|Chinese|Japanese))\b",
        r"\b(?:respond|answer|reply|write|output)\s+(?:only\s+)?(?:in|using)\s+(?:English|French|Spanish|German|Italian|Portuguese|Chinese|Japanese|Korean|Arabic|Hindi|Russian)\b",
    ]),
    ("casing_constraint", "content_style_constraint", [
        r"\b(all (?:in )?uppercase|ALL CAPS|capitalize all|entirely uppercase|all (?:in )?lowercase|entirely lowercase|no capital|title case|camel case|snake case)\b",
    ]),
    ("tone_constraint", "content_style_constraint", [
        r"\b(?:(?:in|use|with)\s+(?:a\s+)?(?:formal|informal|casual|academic|professional|friendly|humorous|sarcastic|polite|neutral|persuasive|conversational|technical)\s+(?:tone|style|register|voice|manner))\b",
    ]),
    ("audience_constraint", "content_style_constraint", [
        r"\b(?:(?:as\s+if|like)\s+(?:you\s+(?:are|were)\s+)?(?:speaking|talking|explaining|writing)\s+to\s+|for\s+(?:a\s+)?(?:child|kid|\d+[- ]?year[- ]?old|beginner|expert|layperson|general\s+audience|student|teenager|professional))\b",
    ]),
    ("perspective_constraint", "content_style_constraint", [
        r"\b(?:(?:in|use|write\s+in)\s+(?:the\s+)?(?:first|second|third)\s+person)\b",
    ]),
    ("topic_scope", "content_style_constraint", [
        r"\b(?:(?:only|exclusively|solely|strictly)\s+(?:about|on|regarding|concerning|related\s+to)|(?:focus|concentrate|stick)\s+(?:on|to)|(?:limit|restrict|confine)\s+(?:your(?:self)?\s+)?(?:to|the\s+(?:scope|topic)))\b",
    ]),
    ("end_with", "content_style_constraint", [
        r"\b(end (?:with|your .+ with)|last (?:word|sentence|line))\b",
    ]),
    ("chain_of_thought", "process_directive", [
        r"\b(?:(?:think|reason|work)\s+(?:(?:it\s+)?(?:out\s+)?)?step[- ]by[- ]step|show\s+(?:your\s+)?(?:work(?:ing)?|reasoning|thought\s+process|steps)|chain[- ]?of[- ]?thought|let'?s\s+think)\b",
    ]),
    ("repeat_prompt", "process_directive", [
        r"\b(repeat .+ prompt|restate .+ question|echo .+ input|first repeat the request)\b",
    ]),
    ("self_evaluation", "process_directive", [
        r"\b(?:rate\s+(?:your\s+)?(?:confidence|certainty|answer|response)|how\s+(?:sure|confident|certain)\s+(?:are\s+you)|on\s+a\s+scale\s+of\s+\d+\s+to\s+\d+)\b",
    ]),
    ("conditional_execution", "process_directive", [
        r"\b(?:if .+ then .+ (?:else|otherwise)|depending on|based on whether)\b",
    ]),
    ("meta_directive", "process_directive", [
        r"\b(follow(?:ing)? (?:the )?instructions?|must (?:include|contain|use|end|start|be)|format your|your response (?:should|must)|answer only|do not say)\b",
    ]),
]

#: (pattern, level, label or None: named after what the pattern captures)
CONSTRAINTS = [
    (
        r"\b(?:at\s+(?:least|most)|(?:no|not)\s+(?:more|fewer|less)\s+than|between\s+\d+\s+and|exactly|up\s+to|minimum|maximum|limit\s+(?:to|of))\s*\d+\s*(words?|sentences?|paragraphs?|characters?|lines?|tokens?|pages?|syllables?|bullet\s*points?|items?|points?)",
        "format_constraint", "length_constraint",
    ),
    (
        r"\b(?:(?:respond|answer|output|write|format|present|return|give|provide)\s+(?:it\s+|your\s+(?:answer|response|output)\s+)?(?:in|as)\s+(?:a\s+)?)(JSON|XML|CSV|YAML|markdown|HTML|table|bullet(?:ed)?\s+(?:list|points?)|numbered\s+list|ordered\s+list|unordered\s+list|dictionary|array|code\s+block)",
        "format_constraint", None,
    ),
    (
        r"\b(?:include|add|insert|begin\s+with|start\s+with|end\s+with|contain)\s+(?:a\s+)?(?:title|header|heading|footer|introduction|conclusion|preamble|postscript|P\.?S\.?|table\s+of\s+contents|appendix|references?\s+section|bibliography)",
        "format_constraint", "structure_constraint",
    ),
    (
        r"\b(?:all\s+(?:in\s+)?(?:uppercase|lowercase|caps|capitals)|entirely\s+(?:in\s+)?(?:uppercase|lowercase)|(?:title|camel|snake|kebab)\s+case|ALL\s+CAPS|no\s+capital(?:s|ization)?)",
        "content_style_constraint", "casing_constraint",
    ),
    (
        r"\b(?:(?:in|use|with)\s+(?:a\s+)?(?:formal|informal|casual|academic|professional|friendly|humorous|sarcastic|polite|neutral|objective|persuasive|authoritative|conversational|technical|simple|eloquent)\s+(?:tone|style|register|voice|manner|language))",
        "content_style_constraint", "tone_constraint",
    ),
    (
        r"\b(?:(?:in|use|write\s+in)\s+(?:the\s+)?(?:first|second|third)\s+person)",
        "content_style_constraint", "perspective_constraint",
    ),
    (
        r"\b(?:(?:as\s+if|like)\s+(?:you\s+(?:are|were)\s+)?(?:speaking|talking|explaining|writing)\s+to\s+|for\s+(?:a\s+)?(?:child|kid|\d+[- ]?year[- ]?old|beginner|expert|layperson|non[- ]?expert|general\s+audience|technical\s+audience|scientist|student|teenager|professional))",
        "content_style_constraint", "audience_constraint",
    ),
    (
        r"\b(?:respond|answer|reply|write|output)\s+(?:only\s+)?(?:in|using)\s+(?:English|French|Spanish|German|Italian|Portuguese|Chinese|Japanese|Korean|Arabic|Hindi|Russian|Dutch|Swedish|Polish|Turkish|Hebrew|Greek|Thai|Vietnamese|Indonesian|Malay|Czech|Romanian|Hungarian|Finnish|Danish|Norwegian|Ukrainian|Bengali|Tamil|Urdu|Swahili)",
        "content_style_constraint", "response_language",
    ),
    (
        r"""\b(?:(?:must|should|need\s+to|have\s+to|make\s+sure\s+to|be\s+sure\s+to|ensure\s+(?:you|to))\s+(?:include|contain|use|mention|incorporate|reference|cite|feature))\s+(?:the\s+)?(?:(?:word|keyword|term|phrase|name|expression|string)s?\s+)?[\"\']?""",
        "content_style_constraint", "keyword_inclusion",
    ),
    (
        r"\b(?:use|mention|include|repeat|say)\s+.{1,40}?(?:at\s+least|at\s+most|exactly|no\s+more\s+than|no\s+fewer\s+than)\s+\d+\s+times?",
        "content_style_constraint", "keyword_frequency",
    ),
    (
        r"\b(?:(?:do\s+not|don'?t|never|avoid|refrain\s+from|without)\s+(?:us(?:e|ing)|includ(?:e|ing)|mention(?:ing)?|refer(?:ring)?\s+to|writ(?:e|ing)|say(?:ing)?)|(?:no\s+(?:use\s+of|mention\s+of|references?\s+to)))",
        "content_style_constraint", "forbidden_words",
    ),
    (
        r"\b(?:(?:no|without|do\s+not\s+use|avoid(?:\s+using)?)\s+(?:commas?|periods?|semicolons?|colons?|exclamation\s+marks?|question\s+marks?|numbers?|digits?|abbreviations?|acronyms?|jargon|slang|contractions?|passive\s+voice|rhetorical\s+questions?))",
        "content_style_constraint", "forbidden_words",
    ),
    (
        r"\b(?:(?:only|exclusively|solely|strictly)\s+(?:about|on|regarding|concerning|related\s+to|discussing|covering)|(?:focus|concentrate|stick)\s+(?:on|to)|(?:limit|restrict|confine)\s+(?:your(?:self)?\s+)?(?:to|the\s+(?:scope|topic|subject)))",
        "content_style_constraint", "topic_scope",
    ),
    (
        r"\b(?:repeat|restate|echo|copy|reproduce)\s+(?:the\s+)?(?:prompt|question|instruction|task|query|input|request|original)",
        "process_directive", "repeat_prompt",
    ),
    (
        r"\b(?:(?:give|provide|write|generate|produce|offer)\s+(?:me\s+)?(?:\d+|two|three|four|five|multiple|several|various)\s+(?:different\s+)?(?:answers?|responses?|versions?|variations?|alternatives?|options?|solutions?|attempts?))",
        "process_directive", "response_count",
    ),
    (
        r"\b(?:(?:think|reason|work)\s+(?:(?:it\s+)?(?:out\s+)?)?step[- ]by[- ]step|show\s+(?:your\s+)?(?:work(?:ing)?|reasoning|thought\s+process|steps)|chain[- ]?of[- ]?thought|let'?s\s+think)",
        "process_directive", "chain_of_thought",
    ),
    (
        r"\b(?:rate\s+(?:your\s+)?(?:confidence|certainty)|how\s+(?:sure|confident|certain)\s+(?:are\s+you)|on\s+a\s+scale\s+of\s+\d+\s+to\s+\d+)",
        "process_directive", "self_evaluation",
    ),
]

#: canonical verb: its variants
VERBS = {
    "create": "write compose draft produce generate build construct develop craft make prepare formulate create design devise author".split(),
    "explain": "explain describe clarify elaborate illustrate elucidate discuss".split(),
    "summarize": "summarize summarise condense recap abridge shorten".split(),
    "analyze": "analyze analyse examine evaluate assess review inspect study investigate critique criticize".split(),
    "compare": "compare contrast differentiate distinguish".split(),
    "extract": "extract identify find locate detect retrieve".split(),
    "edit": "edit revise rewrite rephrase paraphrase reword modify correct fix proofread improve refine polish".split(),
    "list": "list enumerate name outline itemize brainstorm".split(),
    "suggest": "suggest recommend propose advise".split(),
    "answer": "answer respond reply address".split(),
    "classify": "classify categorize categorise label tag sort group".split(),
    "translate": "translate render localize".split(),
    "predict": "predict forecast estimate speculate anticipate".split(),
    "argue": "argue justify debate defend".split(),
    "rank": "rank order prioritize rate score".split(),
    "define": "define interpret".split(),
    "convert": "convert transform change turn".split(),
    "solve": "solve calculate compute".split(),
    "plan": "plan schedule organize arrange".split(),
}

#: part of a source's category name: label
CATEGORIES = {
    "brainstorming": "brainstorming",
    "classification": "classification",
    "closed_qa": "question_answering",
    "creative_writing": "creative_writing",
    "general_qa": "question_answering",
    "information_extraction": "information_extraction",
    "open_qa": "question_answering",
    "summarization": "summarization",
    "natural_questions": "question_answering",
    "trivia_qa": "question_answering",
    "bool_q": "question_answering",
    "sentiment": "classification",
    "translation": "translation",
    "paraphrase": "rewriting_paraphrasing",
    "nli": "logical_deductive_reasoning",
    "commonsense": "commonsense_reasoning",
    "math": "mathematical_reasoning",
    "code": "code_generation",
    "dialogue": "dialogue_generation",
    "capitalize": "casing_constraint",
    "alt_case": "casing_constraint",
    "reverse_correct_answer": "rewriting_paraphrasing",
    "reverse_correct_answer_alt_case": "casing_constraint",
    "correct_answer_words": "output_syntax_format",
    "numformat_numeric": "output_syntax_format",
    "correct_answer_append": "keyword_inclusion",
    "increment_correct_answer_by_one": "output_syntax_format",
    "increment_incorrect_answers_by_one": "output_syntax_format",
    "sort_incorrect": "output_syntax_format",
    "sort_options_to_string": "output_syntax_format",
    "options_to_string": "output_syntax_format",
    "incorrect_options_to_string": "output_syntax_format",
    "print_label": "output_syntax_format",
    "correct_answer_text": "question_answering",
}

ARTICLES = frozenset("""
a an the this that those these some your my his her its our their each every all any
""".split())

SKIPPED_ADJECTIVES = frozenset("""
short brief detailed long new simple good quick possible different specific main important best following
given own various relevant common clear complete full comprehensive small large original first second similar
unique creative appropriate correct proper formal informal concise basic above below certain particular
potential key
""".split())

STOP_WORDS = frozenset("""
the a an this that these those it its he she his her they them their we our you your my me i who whom which
what where when why how there here all each every both few more most other some such no not only same so than
too very just also now then once many much any own in on at to for with by from up about into through during
before after above below between out off over under again further against until while of since unlike although
because besides despite among along across is are was were be been being has have had do does did will would
shall should may might can could must and but or nor if as yet however therefore moreover furthermore
nevertheless according based given please note remember one two three four five first second third people john
liang come time way day year world life part work place case group number new old good well even back still
already often usually sometimes never always
""".split())

GENERIC_OBJECTS = frozenset("""
text data document documents input output result results response information content thing things stuff item
items piece pieces part parts way method approach process form type kind version copy task passage sample
example step steps word words point points section sections line lines set sets model system value values
number numbers case sense sure order game team season year years time times people man woman men women
children child city state country area place home house school company group family world life day days week
month end side hand work war death body head power money bill act law lead down back name later eventually
estimated comeback universal funny changes lions steelers dodgers bears eagles giants cowboys packers broncos
ravens patriots celtics lakers yankees warriors red sox
""".split())
SLOT_ALIASES = {"n": "number", "value": "number", "total": "number", "amount": "number", "count": "number"}

SINGLE_LETTERS = {
    "p": "passage", "s": "sentence", "t": "topic", "a": "option", "b": "option", "c": "option", "d": "option", "e": "option",
    "f": "function_code", "g": "group", "h": "heading", "i": "item", "j": "item", "k": "keyword", "l": "language", "m": "method",
    "n": "number", "o": "option", "q": "question", "r": "role", "u": "unit", "v": "value", "w": "word", "x": "variable",
    "y": "variable", "z": "variable",
}

COLLECTION_SUFFIXES = "_list _array _set _options _values _types _names _items _elements _entries".split()

#: Task types (all others: subject_area) and the slot that a self-replicating option falls back to.
DEFAULT_SLOTS = {
    "classification": "classification_label", "length_constraint": "number", "structure_constraint": "number",
    "keyword_inclusion": "target_word", "keyword_frequency": "target_word", "forbidden_words": "forbidden_word",
    "response_language": "target_language", "casing_constraint": "text_casing", "tone_constraint": "writing_tone",
    "audience_constraint": "target_audience",
}

OLD_LEVELS = {
    "content_task": "task_type", "format": "format_constraint", "style": "content_style_constraint",
    "content_constraint": "content_style_constraint", "meta": "process_directive",
}

CONTENT_SLOTS = "topic description text passage question context content subject title source code example keyword person role task category".split()

LEVEL_KEYWORDS = {
    "format_constraint": "number count length limit unit casing format layout structure frequency".split(),
    "content_style_constraint": "tone style voice register audience mood writing_tone writing_style".split(),
    "process_directive": "reasoning chain_of_thought step".split(),
}

CONTEXT_LABELS = "information_extraction description explanation".split()

#: label: task type: lowest, highest, step
NUMERIC_RANGES = {
    "length_constraint": {
        "creative_writing": (100, 1000, 50), "summarization": (50, 500, 50), "question_answering": (50, 300, 50),
        "explanation": (100, 500, 50), "communication_writing": (50, 300, 50), "_default": (50, 500, 50),
    },
    "structure_constraint": {"brainstorming": (3, 15, 1), "data_analysis": (3, 10, 1), "_default": (3, 8, 1)},
}

KEYWORDS = """innovation sustainability resilience algorithm framework paradigm ecosystem synergy leverage holistic empirical
catalyst trajectory nuance infrastructure benchmark convergence disruption perspective methodology hypothesis correlation
phenomenon principle strategy mechanism dimension architecture optimization dynamic equilibrium""".split()

LANGUAGES = "English French Spanish German Italian Portuguese Japanese Chinese Korean Arabic Russian Hindi Dutch Swedish Polish".split()

END_PHRASES = [
    "hope this helps", "thank you", "the end", "fin", "peace", "sincerely", "best regards", "yours truly", "that is all",
    "in conclusion", "to summarize",
]

LETTERS = list("aeioustrnlc")

FORBIDDEN_WORDS = """very really things stuff nice good bad important interesting basically actually literally amazing awesome
great fantastic wonderful terrible horrible absolutely definitely extremely""".split()

#: Slots that stay as they are; an option that only repeats the name of one says nothing.
PREFERRED_SLOTS = "text_type unit number source_passage problem_statement code_snippet example_context factual_background input_data".split()

#: Where options go that only repeat their slot's name, by value or slot.
SELF_NAMED = {
    slot: words.split()
    for slot, words in {
        "writing_tone": "formal informal professional casual humorous friendly serious sarcastic neutral polite academic analytical",
        "writing_style": "creative",
        "text_type": "bullet bullets list json table markdown",
        "entity_type": "people persons thing things item items",
        "character_name": "character characters",
        "entity_name": "name names",
        "subject_area": "topics",
        "target_word": "word words",
        "keyword_tag": "tag tags hashtag hashtags",
        "text_section": "section sections sentence sentences paragraph paragraphs postscript",
    }.items()
}

#: Object nouns by the task that they name.
TASK_OBJECTS = {
    "summarization": "summary summaries synopsis abstract overview gist",
    "creative_writing": "story stories poem poems essay essays letter song narrative novel blog",
    "code_generation": "code program function algorithm implementation",
    "translation": "translation translations",
    "classification": "classification sentiment opinion",
    "explanation": "explanation explanations definition definitions meaning",
    "question_answering": "question questions answer answers",
    "brainstorming": "ideas suggestions examples reasons ways tips options alternatives list lists",
    "planning": "plan schedule itinerary roadmap",
    "data_analysis": "analysis report chart graph",
    "dialogue_generation": "dialogue conversation chat",
    "rewriting_paraphrasing": "paraphrase",
    "information_extraction": "entities names",
    "mathematical_reasoning": "equation calculation",
    "ranking_comparison": "comparison ranking",
    "fact_verification": "fact claim",
    "text_completion": "sentence paragraph",
}

#: The task of a verb whose object names none.
VERB_TASKS = {
    "summarize": "summarization", "classify": "classification", "translate": "translation", "compare": "ranking_comparison", "analyze": "data_analysis",
    "explain": "explanation", "plan": "planning", "solve": "mathematical_reasoning", "extract": "information_extraction", "edit": "rewriting_paraphrasing",
    "rank": "ranking_comparison", "argue": "argumentation", "predict": "prediction", "define": "explanation", "suggest": "brainstorming", "list": "brainstorming",
    "answer": "question_answering", "convert": "conversion",
}

#: Corrections of single templates by id.
LEVEL_FIXES = {
    "949ef12351": "format_constraint", "7054774d53": "format_constraint", "e28f5a789b": "format_constraint", "27bd8f4114": "format_constraint",
    "99d574dacd": "format_constraint", "b943f4a7ab": "format_constraint", "f2de5b52d3": "format_constraint", "7cae2d01fc": "format_constraint",
    "e845227cc7": "content_style_constraint",
}
CONSTRAINT_RENAMES = ["369c0ad2aa", "e5617457ac"]
