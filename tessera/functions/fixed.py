"""Fixed values of the text rules: patterns and word lists that decide results, in both engines' common dialect.

Word characters are written as classes, and places that must be followed by a capital take the capital in, as the
dialects differ in ``\\w`` and in looking ahead.
"""

#: Credential shapes; a text with one is refused.
SECRETS = (
    r"\b(?:sk|pk|rk)[-_][A-Za-z0-9_-]{12,}",
    r"\bgh[pousr]_[A-Za-z0-9]{16,}",
    r"\bAKIA[0-9A-Z]{12,}",
    r"\bey[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.",
    r"\b[A-Fa-f0-9]{32,}\b",
    r"\b(?:[0-9][ -]?){13,19}\b",
    r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    r"(?i:\b(?:password|passwd|passphrase|secret|api[\s_-]?key|access[\s_-]?token|private[\s_-]?key|credential)s?\b)",
    r"postgres(?:ql)?://\S*:\S+@",
)
#: Labelled credential spans of candidates.
SECRET_SPANS = (
    ("openai_key", r"sk-[A-Za-z0-9]{20,}"),
    ("github_pat", r"ghp_[A-Za-z0-9]{20,}"),
    ("kv_secret", r"(?i)\b(?:api[_-]?key|token|password|secret)\b\s*[:=]\s*[A-Za-z0-9_./+\-]{6,}"),
)
RETRACTION = (
    r"(?i)\b(?:never\s+(?:been|went|gone|visited|lived|stayed|was|were|did|saw|met|said)|(?:was|were)\s+never"
    r"|did(?:n['’]?t|\s+not)\s+actually|actually,?\s+i\s+(?:did(?:n['’]?t|\s+not)|never|was\s*n['’]?t)"
    r"|that(?:['’]s|\s+was|\s+is)?\s+(?:wrong|incorrect|a\s+mistake|not\s+(?:true|right|correct))"
    r"|(?:scratch|forget|ignore|disregard)\s+(?:that|what\s+i\s+said))\b"
)
HABITUAL = r"(?:always|usually|generally|normally|typically|mostly|often|mainly|still)\s+"
#: A sentence that matches one of these is not a durable statement.
UNCERTAIN = (
    r"(?i)\b(?:if|maybe|perhaps|probably|might|may|could|would|should|thinking\s+about|considering|planning\s+to|going\s+to"
    r"|wants?|wanted|want\s+to|wish|hope|suppose|guess|not\s+sure|unsure|i'?m\s+trying\s+to)\b"
)
NEGATED = r"(?i)\b(?:don'?t|doesn'?t|didn'?t|do\s+not|never|no\s+longer|not\s+anymore|isn'?t|aren'?t|wasn'?t|won'?t|can'?t\s+stand)\b"
REJECTED = (
    r"(?i)^\s*(?:(?:can|could|would|should|will|do|does|did|is|are|was|were|have|has|am)\b|(?:who|what|when|where|why|how|which)\b"
    r"|(?:please|let'?s|add|write|make|fix|run|show|give|tell|explain|create|update|remove|delete|check|try|use|implement|refactor"
    r"|commit|push|open|close)\b)",
    r"(?i)^\s*(?:you|it|this|that|there|the|we|they|he|she|claude|the\s+code|the\s+test)\b",
    r"(?i)^\s*my\s+(?:build|test|tests|branch|commit|pr|ci|pipeline|code|repo|repository|server|terminal|error|errors|output|script"
    r"|file|files|function|class|config|log|logs|diff|patch|deploy|deployment|environment|env|venv|container|process|query|request"
    r"|response|session|task|ticket|issue|bug|change|changes)\b",
    r"(?i)^\s*i\s+(?:just\s+|already\s+|finally\s+|" + HABITUAL + r")?(?:ran|run|fixed|fix|deployed|deploy|pushed|push|committed|commit"
    r"|merged|merge|added|add|removed|remove|deleted|delete|tried|try|tested|test|checked|check|opened|open|closed|close|started|start"
    r"|stopped|stop|clicked|typed|asked|updated|update|installed|install|restarted|restart|read|wrote|write|saw|see)\b",
    r"(?i)^\s*i\s+(?:am|'m)\s+(?:done|here|back|ready|stuck|confused|sorry|tired|busy|online|offline|off|away|good|fine|ok|okay|sure"
    r"|curious|lost|blocked|on\s+[A-Za-z0-9_]+|in\s+the\s+(?:middle|process)|at\s+(?:the\s+)?(?:office|desk))\b",
    r"(?i)^\s*i\s+have\s+(?:a|an|some|another|one|two|three)?\s*(?:[A-Za-z0-9_]+\s+){0,2}(?:meeting|call|appointment|deadline|interview"
    r"|flight|reservation|booking|headache|cold|fever|cough|question|idea|problem|issue|error|bug|thought|minute|moment|second|feeling"
    r"|hunch|plan|task|ticket|errand|chore|demo|review)\b",
    r"(?i)^\s*i\s+[A-Za-z0-9_]+(?:\s+[A-Za-z0-9_]+)?\s+(?:this|that|these|those|it|here|there)\b",
    r"(?i)^\s*(?:eu|yo|io|je|j'|ich)?\s*(?:sou|soy|suis|bin|sono)\s+(?:pronto|cansado|ocupado|feito|aqui|listo|aquí|prêt|prête|fatigué"
    r"|occupé|ici|désolé|fertig|müde|beschäftigt|hier|bereit|da|stanco|occupato|qui)\b",
)
PROGRESSIVE = r"(?i)^\s*i\s*(?:am|'m)\s+(?:[A-Za-z0-9_]+ing)\b"
STATIVE_PROGRESSIVE = (
    r"(?i)^\s*i\s*(?:am|'m)\s+(?:currently\s+)?(?:using|learning|studying|living|residing|renting|training|specialising|specializing"
    r"|majoring)\b"
)
#: The first frame that matches names the rule that accepts a sentence.
STATIVE = (
    ("stative-i", r"(?i)^\s*i\s+(?:" + HABITUAL + r")?(?:am|'m|was\s+born|live|reside|work|study|studied|speak|own|have|has|drive|prefer"
     r"|like|love|hate|use|play|need|avoid|keep|maintain|can'?t\s+eat|don'?t\s+eat|am\s+allergic|graduated|grew\s+up)\b"),
    ("stative-i", r"(?i)^\s*i\s+" + HABITUAL + r"[A-Za-z0-9_]+"),
    ("stative-i", r"(?i)^\s*i\s+(?:review|handle|manage|maintain|oversee|own|lead|coordinate|administer|curate|moderate)\b"
     r"(?:\s+[A-Za-z0-9_]+)?\s+(?:every|each|all\s+(?:my|our|the))\s+[A-Za-z0-9_]"),
    ("stative-i", STATIVE_PROGRESSIVE),
    ("stative-my", r"(?i)^\s*my\s+[A-Za-z0-9_'\- ]{2,40}?\s+(?:is|are|was|were|runs|run|lives|sits|listens)\b"),
    ("stative-ml", r"(?i)^\s*(?:eu|yo|io|je|j'|ich)?\s*(?:moro|vivo|vis|resido|habite|habito|wohne|lebe|risiedo|trabalho|trabajo"
     r"|travaille|arbeite|lavoro|sou|soy|suis|bin|sono|falo|hablo|parle|spreche|parlo|prefiro|prefiero|préfère|preferisco|bevorzuge)\b"),
    ("changed-attribute", r"^\s*[Ii]\s+(?:switched|changed)\s+from\s+[A-Z][A-Za-z0-9_.+-]*\s+to\s+[A-Z]"),
)
MIN_WORDS, MAX_CHARS = 2, 300
#: The first pattern found names the attribute; then "my <attribute> is <value>".
ATTRIBUTES = (
    ("residence", r"\bI\s+(?:live|reside)\s+in\s+[A-Z]"),
    ("residence", r"\bI\s+(?:moved|relocated)\s+to\s+[A-Z]"),
    ("residence", r"\bI\s+(?:moved|relocated)\s+from\s+[A-Za-z0-9_]+\s+to\s+[A-Z]"),
    ("employer", r"\bI\s+work\s+(?:at|for)\s+[A-Z]"),
    ("employer", r"\bI\s+left\s+[A-Za-z0-9_\s]{1,40}?\s+and\s+joined\s+[A-Z]"),
    ("employer", r"\bI\s+joined\s+[A-Z]"),
    ("name", r"(?i)\b(?:my\s+name\s+is|I\s+am\s+called|call\s+me)\s+[A-Z]"),
    ("vehicle", r"\bI\s+drive\s+(?:a|an|the)\s+[A-Za-z0-9_\s]*?(?:[A-Z]|\b(?:car|truck|suv|van|bike|motorcycle|scooter|sedan|jeep)\b)"),
)
POSSESSIVE = r"(?i)^\s*my\s+([a-z][a-z '\-]{1,40}?)\s+(?:is|are|was|were)\s+(.+)$"
CLAUSE_VALUE = r"(?i)^(?:that|we|i|it|he|she|they|you|there)\b"
OPINIONS = (
    "opinion", "guess", "point", "concern", "worry", "question", "problem", "understanding", "take", "sense", "feeling", "thought",
    "view", "hope", "impression", "assumption", "belief", "hunch", "bet", "prediction", "expectation", "plan", "read", "instinct",
    "suspicion", "theory",
)
#: A part that opens with one of these does not stand alone; one that stands alone has a verb and a subject or four words.
SUBORDINATOR = (
    r"(?i)^(which|who|whom|whose|where|when|while|although|though|because|since|so|and|or|but|then|thus|hence|especially|including"
    r"|such as|e\.g\.|i\.e\.)\b"
)
SUBJECT = r"(?i)\b(i|we|you|he|she|it|they|there|that|this|my|our|its|their)\b"
VERB = (
    r"(?i)(\b(is|are|am|was|were|be|been|has|have|had|do|does|did|will|can|should|need|needs|use|uses|using|handle|handles|handling"
    r"|cap|caps|prefer|prefers|run|runs|live|lives|moved|going|built|building|require|requires|hold|holds|work|works|skip|skipped|pick"
    r"|picked|set|sets|added|added)\b)|('m|'s|'re|'ve|'ll)"
)
#: Typed candidates, in order.
CANDIDATES = (
    ("user_preference", r"(?i)\b(?:i|user|my|we)\b[^.?!]{0,40}\bprefer(?:s|red)?\b[^.?!]+"),
    ("task", r"(?i)\b(?:remind\s+me|todo|to-do|task|deadline|due)\b[^.?!]+"),
    ("decision", r"(?i)\b(?:we|team|i)\b\s+(?:decided|chose|selected|agreed)\b[^.?!]+"),
    ("correction", r"(?i)\b(?:actually|correction|i\s+meant|to\s+be\s+clear)\b[^.?!]+"),
    ("procedure", r"(?i)\b(?:whenever|always|every\s+time|procedure|workflow|the\s+way\s+to)\b[^.?!]+"),
)
MEETING = r"(?i)\b(?:meeting|standup|sync|call|1[:-]1)\b[^.?!]+"
#: Relations between names: no name begins with one of the stop words. (Looks ahead, so one engine only.)
_STOP = r"(?:works?|working|use|uses|using|created|built|develops?|developed|authored|made|employed|is|are|was|were|by|at|for|and|or|the|a|an)"
_NAME = rf"(?!{_STOP}\b)[A-Za-z0-9][\w&'’-]*"
NAMES = rf"{_NAME}(?:\s+{_NAME}){{0,3}}"
RELATIONS = (
    ("EMPLOYED_BY", rf"(?i)\b({NAMES})\s+(?:works?|working)\s+(?:at|for)\s+({NAMES})"),
    ("EMPLOYED_BY", rf"(?i)\b({NAMES})\s+(?:is|are|was|were)\s+employed\s+by\s+({NAMES})"),
    ("USES", rf"(?i)\b({NAMES})\s+(?:uses?|using|use)\s+({NAMES})"),
    ("CREATED", rf"(?i)\b({NAMES})\s+(?:created|built|developed|authored|made)\s+({NAMES})"),
)
#: Marks that no relation reaches across, and what every text with a relation holds.
RELATION_BORDER = r"""[!"#$%()*+,./:;<=>?@\[\\\]^`{|}~]+"""
RELATION_VERB = r"(?i)\s(?:works?|working|employed|uses?|using|created|built|developed|authored|made)\s"
#: Questions that count, those bound to a window of time, and what they ask for.
COUNTING = r"(?i)\bhow many\b|\bhow much\b|\bhow long\b|\bhow often\b|\b(?:total|number)\s+(?:of|number)\b|\bnumber of\b"
SCOPED = (
    r"(?i)\bin the (?:first|last|past)\s+(?:[A-Za-z0-9_]+\s+)?(?:day|week|month|year)s?\b"
    r"|\b(?:this|last|past|next)\s+(?:[A-Za-z0-9_]+\s+)?(?:day|week|month|year)s?\b"
    r"|\bsince I (?:started|began|moved|got|joined|switched|changed)\b"
    r"|\bin (?:january|february|march|april|may|june|july|august|september|october|november|december)\b"
    r"|\b[A-Za-z0-9_]+\s+(?:days?|weeks?|months?|years?)\s+ago\b"
)
SUM_INTENT = r"(?i)\bhow (?:much|long)\b|\btotal\b|\bin total\b|\baltogether\b|\bcombined\b|\b(?:hours?|minutes?|days?|weeks?|months?|years?|dollars?|\$)\b"
COUNT_INTENT = r"(?i)\bhow many\b|\bnumber of\b"
MONEY_SUM = r"(?i)\bhow much\b.*\b(?:spen[dt]|cost|pay|paid|money|amount|total|\$)\b|\btotal\b.*\b(?:spen[dt]|cost|amount|money)\b"
PREPOSITIONS = ("from", "of", "in", "on", "with", "for", "at", "to", "by")
#: Types of questions: the first rule that matches.
QUESTION_TYPES = (
    ("abstain", r"(?i)\b(?:did i (?:ever )?(?:mention|say|tell|talk about)|have i (?:ever )?(?:mentioned|said|told))\b"),
    ("count", r"(?i)\bhow\s+(?:many|much)\b"),
    ("duration", r"(?i)\b(?:how\s+long|duration|takes?\s+to|(?:taken|spent|spend)\s+(?:to|on))\b"),
    ("date_time", r"(?i)\b(?:when|what\s+(?:date|day|month|year|time)|which\s+(?:day|month|year))\b"),
    ("knowledge_update", r"(?i)\b(?:previously|used\s+to|change[ds]?|changed?|updated?|old(?:er)?|new(?:er)?|(?:before|after)\s+(?:and|vs|or)"
     r"|current(?:ly)?\s+versus|was\s+[A-Za-z0-9_]+\s+now\s+is)\b"),
    ("temporal_reasoning", r"(?i)\b(?:before|after|earliest|latest|first|last|this\s+(?:year|month|week)|last\s+(?:year|month|week)"
     r"|(?:order|sequence|timeline|chronolog))\b"),
    ("preference", r"(?i)\b(?:prefer(?:ence|red)?|favou?rite|like\s+to|dislike|avoid|favou?r)\b"),
    ("location", r"(?i)\bwhere\b"),
    ("person", r"(?i)\bwho\b"),
    ("entity_name", r"(?i)\b(?:what\s+(?:is|are|'s)\s+(?:the\s+)?name|what(?:'s| is)\s+it\s+called|name\s+of\s+(?:the\s+)?[a-z]+)\b"),
)
MULTI_SESSION = r"(?i)\b(?:across|total\s+(?:over|across)|combined|in\s+total|all\s+the\s+(?:sessions|conversations))\b"
#: A statement that names what it replaces.
REPLACES = r"\b(?:switched|moved|migrated|changed|upgraded)\s+from\s+([A-Z][A-Za-z0-9_.+-]*)\s+to\s+[A-Z]"
#: Which mode a question's wording asks for, in order; then the dataset's type, else a fact.
ROUTES = (
    ("assistant_memory_lookup", r"(?i)\b(?:you\s+(?:told|said|recommended|suggested|mentioned|asked|advised|provided|gave|shared|listed|named|noted)"
     r"|did\s+you\s+(?:recommend|suggest|mention|tell|ask|provide|give|share|list|name)|what\s+(?:did\s+you\s+say|advice\s+did\s+you|book\s+did\s+you))\b"
     r"|\b(?:remind\s+me|do\s+you\s+remember|we\s+(?:talked|chatted|discussed|spoke)\s+about"
     r"|(?:our|the|in\s+(?:our|the))\s+(?:previous|earlier|last|prior)\s+(?:conversation|chat|session|discussion|talk)|check\s+back\s+(?:on|with))\b"
     r"|\bwhat\s+(?:was|were)\s+the\s+[A-Za-z0-9_]+(?:\s+[A-Za-z0-9_]+){0,3}\s+you\s+(?:gave|provided|told\s+me|sent|recommended|suggested|named|listed|shared)\b"),
    ("knowledge_update", r"(?i)\b(?:current(?:ly)?|now|these\s+days|latest|most\s+recent|today|updated|changed|change\s+to|new\s+[A-Za-z0-9_]+\s+(?:is|name)"
     r"|used\s+to\s+[A-Za-z0-9_]+\s+(?:but|and)\s+now|previously\s+[A-Za-z0-9_]+\s+now)\b"),
    ("preference_profile", r"(?i)\b(?:prefer(?:ence|red)?|favou?rite|do\s+i\s+like|do\s+i\s+prefer|my\s+favou?rite|what\s+(?:do\s+i\s+)?(?:like|prefer|enjoy|hate|avoid))\b"),
    ("temporal_reasoning", r"(?i)\b(?:how\s+long\s+ago|how\s+many\s+(?:days|weeks|months|years)\s+(?:ago|since|between)|between\s+[A-Za-z0-9_]+\s+and\s+[A-Za-z0-9_]+"
     r"|how\s+long\s+(?:has|have)|elapsed|before|after|earliest|latest|first|last|when\s+did\s+i)\b"),
    ("multi_session_aggregate", r"(?i)\b(?:in\s+total|altogether|combined|across\s+(?:all\s+)?(?:sessions|trips|years|months|weeks)|sum\s+of|each\s+of"
     r"|all\s+the\s+[A-Za-z0-9_]+s\b|different\s+[A-Za-z0-9_]+s\b|how\s+(?:many|much)\s+(?:in\s+total|altogether|combined|across)|list\s+(?:all|the))\b"),
)
#: A later statement that ends an earlier one.
UPDATE_MARKERS = (
    r"(?i)\b(no\s+longer|used\s+to|previously|formerly|now\s+(?:lives?|works?|owns?|uses?|prefers?|drives?|studies?)|changed\s+(?:to|from)"
    r"|switched\s+(?:to|from)|replaced\s+with|instead\s+of|moved\s+(?:to|from)|relocated\s+to)\b"
)
NUMBER_WORDS = (
    ("zero", "0"), ("one", "1"), ("two", "2"), ("three", "3"), ("four", "4"), ("five", "5"), ("six", "6"), ("seven", "7"), ("eight", "8"), ("nine", "9"),
    ("ten", "10"), ("eleven", "11"), ("twelve", "12"), ("thirteen", "13"), ("fourteen", "14"), ("fifteen", "15"), ("sixteen", "16"), ("seventeen", "17"),
    ("eighteen", "18"), ("nineteen", "19"), ("twenty", "20"), ("thirty", "30"), ("forty", "40"), ("fifty", "50"), ("sixty", "60"), ("seventy", "70"),
    ("eighty", "80"), ("ninety", "90"), ("hundred", "100"),
)
UNKNOWN = r"(?i)\b(?:i don't know|i do not know|not mentioned|not enough information|cannot determine|no information|i couldn't find|do not know)\b"
#: What a question asks for, in order (relation, shape of the answer, pattern); the first that matches counts.
OCCASIONS = r"birthday|anniversary|graduation|wedding|christmas|housewarming"
INTENTS = (
    ("previous_occupation", "occupation_title", r"(?i)\bwhat\s+(?:was|is)\s+my\s+(?:previous|former|old|last|past)\s+(?:occupation|job|role|position|career|profession)"),
    ("previous_occupation", "occupation_title", r"(?i)\bwhat\s+(?:role|job|position|occupation|career)\s+did\s+I\s+(?:have|hold|work|do)\s+(?:before|previously|in\s+the\s+past)"),
    ("previous_occupation", "occupation_title", r"(?i)\bwhat\s+did\s+I\s+(?:used?\s+to|previously)\s+(?:work|do)\s+(?:as|in)\b"),
    ("previous_occupation", "occupation_title", r"(?i)\bwhat\s+did\s+I\s+do\s+for\s+(?:work|a\s+living)\s+(?:before|previously|in\s+the\s+past)"),
    ("degree_in", "field_of_study", r"(?i)\bwhat\s+(?:degree|field|major|discipline)\s+(?:did\s+I\s+)?(?:get|graduate|earn|study|complete)"),
    ("bought_gift_for", "purchased_item", r"(?i)\bwhat\s+did\s+I\s+(?:buy|bought|get|pick\s+up|purchase|gift)\s+"),
    ("value_compared_to_paid", "comparative_phrase", r"(?i)\bhow\s+much\s+is\s+.+?\s+worth\b.*?(?:paid|spent|in\s+terms\s+of)"),
    ("count_packed", "count_with_unit", r"(?i)\bhow\s+many\s+\w+\s+(?:did\s+I\s+|i\s+)?(?:pack|bring|take)"),
    ("event_date", "date", r"(?i)\bwhen\s+(?:did|was|is)\s+(?:I\s+)?"),
)
#: What a relation's question may state: (relation, slot, pattern, group).
SLOTS = (
    ("bought_gift_for", "recipient", rf"(?i)\bfor\s+my\s+(\w+)['’]?s?\s+(?:{OCCASIONS})", 1),
    ("bought_gift_for", "occasion", rf"(?i)\bfor\s+my\s+\w+['’]?s?\s+({OCCASIONS})", 1),
    ("count_packed", "item", r"(?i)\bhow\s+many\s+(\w+)\s+(?:did\s+I\s+|i\s+)?(?:pack|bring|take)", 1),
    ("count_packed", "destination", r"\b(?:for|to|on)\s+(?:the\s+|my\s+)?((?:trip|vacation|holiday)\s+to\s+\w+|[A-Z][\w\- ]*?\w)\s*(?:[.!?,;]|$)", 1),
    ("event_date", "event", r"(?i)\b(?:the\s+|my\s+)?([a-z][\w' ]*?(?:dinner|event|party|wedding|graduation|conference|meeting|interview|appointment|reunion|fundraiser|fundraising|ceremony|gathering))\b", 1),
    ("value_compared_to_paid", "asset", r"(?i)\b(?:how\s+much\s+is\s+|what\s+is\s+)(?:the\s+|my\s+)?([a-z][\w' ]{2,40}?)\s+worth\b", 1),
)
#: Phrases that open a gate, anywhere in the lower-case question.
GATES = {
    "preference": ("recommend", "suggest", "which should i", "what should i", "best for me", "best option", "resources", "ideas for", "tailor", "personali", "based on my", "for my"),
    "temporal": ("how many days", "how many weeks", "how many months", "how many years", "how long ago", "how long since", "how long has", "days passed", "weeks ago", "months ago", "years ago", "weeks have passed",
                 "months have passed", " since ", " before ", " after ", "in what order", "in the order", "which happened first", "which came first", "earlier or later"),
    "knowledge_update": ("currently", "current", "these days", "right now", "as of now", "still ", "anymore", "now that", "most recent", "latest", "up to date", "nowadays"),
}
#: Words of questions that name a relation.
RELATION_WORDS = {
    "is_worth": ("worth", "value", "valued", "cost", "costs"), "paid": ("pay", "paid", "spent", "spend"), "duration_of": ("took", "lasted"), "located_at": ("where",),
    "got_at": ("got", "earned", "completed", "finished", "graduated"), "date": ("when",), "person": ("who",),
}
QUESTION_STOP_WORDS = (
    "a an the and or but of for to in on at by with from as is are was were be been i me my you your we us our they them this that it its if then what which who whom whose where when why how "
    "do does did have has had can could should would will shall many much few several long lot more less").split()
#: Verbs that do not say what a question is about.
NO_ANCHORS = (
    "get got buy bought make made pay paid spent spend took take give gave send sent find found earn earned complete completed finish finished graduate graduated attend attended visit visited use used "
    "go went come came see saw do done live lived work worked amount").split()
SCOPE = (
    r"(?i)\b(?:\d{4}|today|yesterday|tomorrow|tonight|recently|currently|now|last\s+(?:week|month|year|sunday|monday|tuesday|wednesday|thursday|friday|saturday|night)|next\s+(?:week|month|year)|in\s+\d{4}"
    r"|since\s+\d{4}|before\s+\d{4}|after\s+\d{4}|jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
    r"|mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\b")
#: Types of questions whose parts may be of another type.
COMPOSED = ("generic_fact", "temporal_reasoning", "knowledge_update")
#: The reply of a decomposer: numbers and bullets before a line; and questions that ask for one fact of the user's own.
BULLET = r"^\s*(?:\d+[.)]|[-*•])\s*"
ONE_FACT = (r"(?i)^\s*(?:what|where|when|who|which|how\s+(?:long|many|much|old))\b", r"(?i)\b(?:i|me|my|mine)\b")
NOT_ONE_FACT = (r"(?i)\bhave\s+i\b", r"(?i)\b(?:and|or|before|after|earlier|later|first|last|both|between|compare|compared|difference|changed|update|newer|older|more|less)\b")
#: Statements that pages are made of: (fact, topic, patterns of which the first that matches counts).
WIKI_FACTS = (
    ("spotify_playlist", "music", (r"(?i)playlist on Spotify that I created,\s*called\s+([^,.]+)",)),
    ("commute_duration", "commute", (r"(?i)commute,\s*which takes\s+([^,.]+)", r"(?i)daily commute takes\s+([^,.]+)")),
    ("target_coupon_redeemed", "shopping", (r"(?i)redeemed a\s+\$?\d+\s+coupon on\s+([^,.]+)",)),
    ("degree", "education", (r"(?i)degree in\s+([^,.]+)",)),
    ("theater_play", "hobbies", (r"(?i)(?:production of|play called|play named)\s+([^,.?]+)",)),
)
COUPON_AMOUNT = r"(?i)redeemed a\s+\$?(\d+)\s+coupon on\s+[^,.]+"
COUPON_TIME = r"(?i)\s+(?:last|this|next)\s+\w+$"
TOPIC_TERMS = (
    ("music", "spotify|playlist|music|lo-fi|ambient"), ("commute", "commute"), ("shopping", "target|coupon|cartwheel|shopping"), ("education", "degree|university|school|education"),
    ("health_fitness", "fitness|run|workout|health"), ("hobbies", "guitar|hobby|theater|play"),
)
LEXICAL_STOP_WORDS = "the and for with that this what where when who which how did does was were is are am to of on in at a an".split()
#: Points for a turn (question, turn, unless the turn, points).
LEXICAL_BOOSTS = (
    (r"\bhow\s+long\b", r"\b(?:minute|minutes|hour|hours|each way|one way|round trip)\b", None, 0.75), (r"\bwhere\b", r"\b(?:target|walmart|costco|kroger|store|shop|app)\b", None, 0.25),
    (r"\bname\b", r"\b(?:called|named|titled)\b", None, 0.35), (r"\b(?:clothing|clothes|items? of clothing)\b", r"\b(?:blazer|boots?|jeans?|shirt|sweater|dress|pants|jacket)\b", None, 0.4),
    (r"\bpick\s+up\b", r"\bpick\s+up\b|\bdry cleaning\b", None, 1.2), (r"\breturn\b", r"\breturn\b|\bexchang(?:e|ed|ing)\b", None, 1.0),
    (r"\bcamping trips?\b", r"\b\d+\s*-\s*day\b.*\bcamping trip\b", None, 2.5), (r"\bcamping trips?\b", r"camping trip", r"\b\d+\s*-\s*day\b.*\bcamping trip\b", 1.25),
    (r"\bmodel kits?\b", r"\b(?:model kit|kits?|revell|tamiya|spitfire|tiger|bomber|camaro)\b", None, 1.25), (r"\bmodel kits?\b", r"\b\d+/\d+\s+scale\b", None, 0.75), (r"\bprojects?\b", r"\b(?:led|lead|leading)\b", None, 1.25),
)
LEXICAL_WEIGHT, USER_POINTS, ASSISTANT_POINTS = 4.0, 1.25, -0.25
#: What is no answer. Labels alone, or with two characters after them, in normalised text.
SCAFFOLD = (
    "evidence window|matched turn|nearby context|sub answer|subanswer|candidates|matching facts|matching fact|reviewing the candidates|reviewing candidates|i dont know|i do not know|no information|not mentioned"
    "|final answer|verified evidence|no evidence|no candidates")
SCAFFOLD_ALONE = "answer|question|evidence|summary|facts|context|session|turn|role user|role assistant|user|assistant|system"
ROLE_PREFIX = r"(?i)^\s*(?:-\s+)?(?:turn\s+\d+\s+)?\(?(?:user|assistant|system)\)?\s*:"
INTRO = (
    r"(?i)^\s*(?:sure(?:,?\s+(?:here(?:'?s)?|here\s+(?:are|is)|let\s+me|i'?ll|i\s+can|absolutely|of\s+course))?|of\s+course(?:!|,)?|absolutely(?:!|,)?|certainly(?:!|,)?|definitely(?:!|,)?|great\s+question(?:!|,)?"
    r"|that'?s\s+a\s+great\s+question|here(?:'?s|\s+(?:is|are|you\s+go))|here\s+are\s+(?:some|a\s+few|the|\d+)|i'?d\s+be\s+happy\s+to|i\s+would\s+be\s+happy\s+to"
    r"|let\s+me\s+(?:help|know|see|think|check|share|give|provide)|good\s+(?:question|point)|happy\s+to\s+help)\b")
REFUSAL = r"(?i)i don't know|i do not know|i'm not sure|i am not sure|no information|not mentioned|unclear|no idea"
ANALYSIS = r"(?i)^\s*(?:based on|looking at|after reviewing|considering|reviewing|the (?:answer|evidence) (?:is|suggests|indicates)|according to|it (?:seems|appears|looks)|i (?:would|think|believe|am))\b"
LABEL_LINE = r"(?i)^\s*(?:occasion|topic|subject|category|tags?|date|time|location|venue|event|type|notes?|context|setting|gift|recipient|present|item|reminder|attendees?)\s*:"
BOLD_LINE = r"(?s)^(?:\*\*.*\*\*|__.*__)$"
REQUEST = (
    r"(?i)^\s*(?:can\s+you|could\s+you|would\s+you|will\s+you|please|help\s+me|tell\s+me|let\s+me\s+know|may\s+I|do\s+you\s+have\s+any|any\s+(?:advice|recommendations?|suggestions?|tips)|how\s+(?:do|would|can|could)\s+I"
    r"|brainstorm|generate|create|write|make|draft|draw|design|build|give\s+me|show\s+me|find\s+me|search\s+for|come\s+up\s+with|list\s+(?:out|some|the|all)|suggest\s+(?:some|a\s+few|the)|recommend\s+(?:some|a\s+few|the)"
    r"|explain\s+(?:how|why|the|what)|describe\s+(?:how|the|a)|outline\s+(?:the|a|some)|prepare\s+(?:a|the|some)|summari[sz]e\s+(?:the|a)|compare\s+(?:the|these|a)|provide\s+(?:me\s+with\s+|a\s+|some\s+|the\s+)?)\b")
TIMESTAMP_JUNK = r"(?i)\b\d{1,3}\s+(?:for|share|principles|every|worked|applied|completely|as|of|is|in|on|to|with|from|by|the|and|or|but)\b"
MATCHING_FACTS = r"(?is)^\s*matching\s+facts?\s*:.*?(sub[-\s]?answer\s*:|\z)"
SUB_ANSWER = r"(?is)sub[-\s]?answer\s*:\s*(.+?)\s*\z"
#: What an answer of a type must hold (lower-case text), in any one of the patterns of each group.
NUMBER_SHAPE = (r"\d|(?:^|[^a-z])(?:zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|hundred)(?:[^a-z]|$)")
UNIT_SHAPE = r"(?:^|[^a-z])(?:second|minute|hour|day|week|month|year|min|hr|sec|yr)s*(?:[^a-z]|$)"
DATE_SHAPE = (
    r"\d|january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
    r"|today|yesterday|tomorrow|last|next|this|ago|morning|afternoon|evening|night|weekend|\b(?:mon|tues?|wed|thurs?|fri|sat|sun)(?:day)?\b")
NAME_SHAPE = r"\b[A-Z][a-zA-Z]+\b"
PLACE_WORDS = r"store|shop|app|website|venue|park|library|office|school|university|college|restaurant"
EVENT_START = r"(?i)^\s*(?:redeemed|bought|attended|saw|did|spent)\b"
ADVICE_START = r"^(?:you should|it is recommended|consider |try |i recommend|you could|you might)"
ECHO_STOP_WORDS = (
    "a an the and or but of to in on at for from with by as is are was were be been being do does did have has had i me my mine we us our you your he she it they them their "
    "what when where who whom which why how that this these those any some").split()
