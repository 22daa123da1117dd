"""Fixed word lists of the text operators in this subpackage. Operators take them as arguments; these are the defaults."""

# Common function words, the evidence of a language.
FUNCTION_WORDS = {
    "en": "the and to in was were that for with on as at by from which who what how did had this than only not but is are be it its their his her about after before during between among those these near most some any",
    "de": "der die das und zu in war waren dass für mit auf als bei von aus welche wer was wie nicht aber ist sind es man im den dem des ein eine einen über nach vor zwischen noch oder am ob warum wurde wurden sich wo sah fand",
    "fr": "le la les et à dans était étaient que pour avec sur comme chez par de du des qui quoi comment ne pas mais est sont un une au aux ce cette en on selon entre après avant où plus il elle sous vers du moins furent",
    "es": "el la los las y a en era eran que para con sobre como por de del desde quien qué cómo no pero es son un una al lo se su entre después antes donde más según hubo fue fueron todavía ya sin había quién",
}

# Words of which a placeholder answer consists.
PLACEHOLDERS = "null none na n/a nil nan undefined empty tbd todo answer overview antwort réponse respuesta summary response".split()

# Ways to ask for a language.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles",
    "de": "german deutsch allemand alemán aleman",
    "fr": "french französisch franzosisch français francais francés frances",
    "es": "spanish spanisch espagnol español espanol",
}

# Openings that carry no answer of their own.
OPENERS = [
    "unfortunately", "regrettably", "apologies", "i am sorry but", "i'm sorry but", "i'm sorry", "sorry but", "sorry", "hm", "thank you for asking", "after reading the passages", "i apologize but", "i apologise but",
    "leider gilt", "leider", "es tut mir leid", "danke für die frage",
    "malheureusement", "je suis désolé", "merci de votre question mais", "merci de votre question",
    "por desgracia", "lo siento", "gracias por la pregunta pero", "gracias por la pregunta", "lamentablemente",
]

# Refusals and reports that nothing was found; * stands for a few words of any kind.
REFUSALS = [
    "i can't help with that request", "i cannot help with that", "i can't assist with that", "i am unable to help with that",
    "i cannot answer this question", "i can't answer that question", "i am not able to answer", "i'm unable to answer",
    "i have to decline", "i must decline", "i decline to answer", "i must leave this one unanswered",
    "this is outside of what i may talk about", "as an assistant i don't have access to the archive", "as an ai i cannot answer",
    "i am unable to provide details about *", "i'm unable to provide details about *", "i cannot provide information about *",
    "i won't be able to discuss *", "i'd rather not speculate about *", "i would rather not discuss *",
    "it would not be appropriate for me to comment on *", "a reply on * is beyond what i can offer",
    "the provided passages do not let me answer this", "the passages do not contain enough information to answer",
    "no relevant information found", "no relevant information was found", "no information on this topic was found",
    "we were not able to find anything about *", "i was not able to find anything about *",
    "nothing on this topic is contained in the documents so no answer can be given", "i could not find any information about *",
    "diese frage kann ich nicht beantworten", "dazu kann ich keine auskunft geben", "zu * liegen keine angaben vor eine antwort ist nicht möglich", "zu * liegen keine angaben vor", "hier muss ich passen", "ich möchte mich zu * nicht äußern",
    "* kann ich nicht beantworten", "ich kann diese frage nicht beantworten", "keine relevanten informationen gefunden", "es wurden keine relevanten informationen gefunden",
    "je ne peux pas répondre à cette question", "je dois décliner", "je préfère ne pas me prononcer sur *", "je ne suis pas en mesure de répondre",
    "aucune information pertinente n'a été trouvée", "aucune information pertinente trouvée", "nous n'avons rien trouvé sur *", "il m'est impossible de parler de *",
    "no puedo responder a esa pregunta", "debo abstenerme", "no me es posible hablar de *", "prefiero no pronunciarme sobre *",
    "no se encontró información relevante", "no he encontrado información relevante", "no hemos encontrado nada sobre *", "no hay datos sobre *",
]

# Words that say the same in a refusal; a template and a sentence are compared by the names of these classes.
CLASSES = {
    "<i>": "i we", "<cannot>": "cannot can't couldn't won't wouldn't mustn't shan't don't", "<unable>": "unable incapable", "<that>": "that this these those it",
    "<answer>": "answer answering help helping assist assisting discuss discussing comment commenting respond responding reply replying talk talking speak speaking say saying tell telling address addressing speculate speculating elaborate elaborating",
    "<question>": "question questions request requests query queries topic matter subject",
    "<kann>": "kann darf möchte will werde könnte können dürfen möchten wollen werden", "<sagen>": "beantworten sagen helfen antworten äußern kommentieren besprechen erläutern mitteilen weiterhelfen sprechen reden", "<das>": "das dies dazu darüber hierzu hierüber diese dieser",
    "<peux>": "peux peut puis pouvons souhaite souhaitons veux voulons", "<répondre>": "répondre aider commenter parler discuter dire prononcer renseigner",
    "<puedo>": "puedo podemos quiero queremos deseo debo", "<responder>": "responder contestar ayudar ayudarle ayudarte comentar hablar decir discutir pronunciarme",
}

# Words that a refusal may have anywhere.
FILLERS = frozenset("leider unfortunately sadly regrettably really simply also malheureusement hélas lamentablemente desgraciadamente bitte please you ihnen vous".split())

# Beginnings that decline, whatever follows.
DECLINES = [
    "i cannot answer *", "i cannot be answering *", "i am unable to answer *", "i am not able to answer *", "i am not allowed to answer *", "i am not in a position to answer *", "i don't feel comfortable answering *",
    "i am not comfortable answering *", "that is not something i can answer *", "that is not something i am able to answer", "i prefer not to answer *", "i would rather not answer *", "i'd rather not answer *", "i refuse to answer *", "i have nothing to say about *",
    "das kann ich nicht sagen *", "ich kann das nicht sagen *", "ich kann darüber nicht sagen", "dazu kann ich nichts sagen *", "ich bin nicht in der lage das zu sagen *", "ich bin nicht befugt *", "darüber kann ich keine auskunft geben *", "dabei kann ich nicht helfen *",
    "je ne peux pas répondre *", "je ne peux rien dire *", "je ne suis pas en mesure de répondre *", "je ne suis pas autorisé à répondre *", "il m'est impossible de répondre *", "je préfère ne pas répondre *", "je refuse de répondre *",
    "no puedo responder *", "no estoy en condiciones de responder *", "no me es posible responder *", "me es imposible responder *", "prefiero no responder *", "me niego a responder *",
]

# Abbreviations whose full stop ends no sentence.
TITLES = "mr mrs ms dr messrs st vol no nr prof hon sr sra".split()

# More of them, around names.
AROUND_NAMES = "esq jr rev bros co ltd inc corp gebr cie".split()
