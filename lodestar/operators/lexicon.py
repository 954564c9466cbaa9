"""Word lists and patterns that results must share, in natural order."""

STOP_WORDS = (
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will "
    "would could should may might shall can this that these those i you he she it we they me him her us them my your his its our "
    "their what which who whom when where why how all each every both few more most other some such no not only own same so than too very "
    "just because if about up out then here there also into over after before between under again"
).split()

CATEGORY_KEYWORDS = {
    "science_research": "research study experiment hypothesis theory journal peer-reviewed paper scientific laboratory empirical".split(),
    "programming_engineering": "code programming software developer api database algorithm python javascript html css git linux".split(),
    "university_learning": "course lecture textbook curriculum syllabus exam university college degree semester class".split(),
    "knowledge_foundations": "encyclopedia history philosophy geography culture religion mythology art music literature language".split(),
    "data_economics": "data statistics economics finance market gdp demographics census survey chart graph dataset".split(),
    "deep_thinking": "logic reasoning argument debate analysis critique essay opinion perspective theory framework model".split(),
}

STRONG = [
    "as an? (?:ai|artificial intelligence|language model|assistant|llm)",
    "i(?:'m| am) (?:an?|a) (?:ai|language model|assistant|chatbot)",
    "i (?:cannot|can't|am unable to) (?:browse|access the internet|view images|see images)",
    "my (?:knowledge|training data) (?:cutoff|ends|is limited|goes up to)",
    "let me (?:break this down|explain|help you|tell you|share|provide)",
    "here(?:'s| is) (?:a|an|the) (?:comprehensive |quick |detailed |complete )?(?:summary|breakdown|overview|explanation|guide)",
    "i (?:hope|would be happy) to (?:help|assist|elaborate|explain|clarify)",
    "i (?:would|can) (?:be happy|love|glad) to (?:help|assist|elaborate)",
    "please (?:let me know|feel free|don't hesitate)",
    "(?:great|excellent|good) question[!.]?",
    "to (?:summarize|summarise|wrap up|recap)\\b",
    "without further ado",
]

WEAK = [
    "it(?:'s| is) important to (?:note|mention|consider|remember)",
    "it(?:'s| is) worth noting that",
    "here are (?:some|a few|the|several) (?:key|important|essential|notable|tips|ways|steps)",
    "harness(?:ing)? the (?:power|potential|capabilities)",
    "(?:leverage|utilize|optimize|maximize) (?:the|this|that|your|our|its)",
    "(?:robust|comprehensive|holistic|streamlined|seamless|intuitive|scalable) (?:approach|solution|framework|experience|interface|strategy|method)",
    "(?:empower|enable|facilitate|enhance|streamline) (?:users|individuals|teams|businesses|your)",
    "(?:delve|dive) (?:deeper|further|into|beneath)",
    "(?:paint|shed) (?:a )?(?:better|clearer|more complete|a fuller) picture",
    "the (?:realm|domain|landscape|frontier|paradigm) of",
    "let(?:'s| us) (?:explore|dive|delve|uncover|examine)",
    "(?:journey|exploration) (?:into|through|of)",
    "in today(?:'s|s) (?:fast-paced|digital|modern)",
    "(?:unlock(?:ing)?|discover(?:ing)?|reveal(?:ing)?) (?:the|your|hidden|untapped)",
    "(?:stay tuned|keep reading|read on|scroll down|continue reading|don't miss)",
    "the (?:key takeaway|bottom line) is",
    "when it comes to",
    "it(?:'s| is) (?:not only|not just) about",
]

TRANSITIONS = (
    "furthermore moreover additionally consequently therefore thus however nevertheless notwithstanding subsequently accordingly "
    "hence likewise similarly meanwhile conversely alternatively"
).split()

HEDGES = ["perhaps", "possibly", "might", "could", "may", "arguably", "seemingly", "apparently", "presumably", "it seems", "it appears", "it could be argued", "one could argue", "it is worth noting", "it is important to note", "generally speaking", "broadly speaking", "in many cases", "in most cases"]

LANGUAGE_WORDS = {
    "en": "the and of to in is that it for was with as".split(),
    "es": "el la de que y en un ser se no por con los las".split(),
    "fr": "le la de et les des en un du une que est pour".split(),
    "de": "der die und in den von zu das mit sich des auf ist".split(),
    "pt": "o a de que e do da em um para com os no".split(),
}

PROVIDER_WEIGHTS = {
    "local": 1.00, "duckdb": 0.98, "github": 0.95, "stack": 0.90, "wikipedia": 0.92, "wikidata": 0.90, "osm": 0.90, "openalex": 0.88, "crossref": 0.85, "yandex": 0.86,
    "yandex_images": 0.85, "products": 0.84, "youtube": 0.85, "hn": 0.84, "commons": 0.82, "rss": 0.82, "gdelt": 0.80, "openverse": 0.78, "ccindex": 0.72, "archive": 0.72,
}

STRUCTURE = [
    r"(?:^|\n)#{1,3}\s+\d+[\.\)]\s+",
    r"(?:^|\n)\*\*Step \d+",
    r"(?:^|\n)[✅🔹📌💡🚀✨⭐🏷️📋📝🔍🎯📊📈⬇️➡️] ",
    r"(?:^|\n)[-—] Step \d+",
    r"(?:^|\n)\*\*\d+[\.\)]\s+\*\*",
    r"(?:^|\n)[⚠️❗‼️] ",
    r"(?:^|\n)[📱💻🔧🛠️⚙️🔑🔐💳] ",
]

PLATFORM = [
    r"(?:generated|created|written|produced|drafted) by (?:openai|chatgpt|gpt-4o?|gpt-3\.5|claude|gemini|copilot)",
    r"powered by (?:openai|chatgpt|gpt-4o?|claude|gemini|copilot)",
    r"(?:ai|artificial intelligence)[ -]generated",
    r"this (?:content|text|response|answer|article) was (?:generated|created|written|produced) by",
    r"(?:written|composed|drafted) by an? (?:ai|language model|llm|chatbot)",
    r"(?:an? )?(?:ai|chatbot|language model|llm) (?:wrote|composed|generated|produced|drafted) (?:this|the following)",
]

FORMATTING = [
    r"(?:^|\n)#{1,2}\s+(?:Step|Phase|Stage|Part) \d+",
    r"(?:^|\n)#{1,2}\s+(?:Introduction|Conclusion|Summary|Overview|FAQ|Key Takeaways)",
    r"(?:^|\n)---+\s*$",
    r"(?:^|\n)>\s+\*\*Note:\*\*|>\s+\*\*Important:\*\*|>\s+\*\*Tip:\*\*",
    r"(?:^|\n)\|\s+.*\s+\|\s+.*\s+\|",
]

GENERIC_AUTHORS = ["admin", "administrator", "editor", "editorial team", "staff", "webmaster", "unknown", "guest", "user", "author"]

SPAM_DOMAINS = (
    "facebook.com fb.com fb.watch fbsbx.com instagram.com cdninstagram.com tiktok.com "
    "essaypro.com essaywriter.net cheapessay.net grademiners.com studybay.com speedyessay.com essaybox.com essayoneday.com penmypaper.com papercoach.net writemypapers.org "
    "jennifertimothyblog.com myblog-u.com blogbazooka.com masstamilan.in techybois.com techhub-news.com "
    "aiwritershub.com chatgptwriter.com aicontentpro.com contentbot.ai writesonic.com jasper.ai rytr.me copy.ai peppertype.ai"
).split()

TRUSTED_DOMAINS = {
    "wikipedia.org": 1.0, "britannica.com": 0.98, "stanford.edu": 0.97, "arxiv.org": 0.96, "nature.com": 0.98, "science.org": 0.98, "mit.edu": 0.97, "harvard.edu": 0.97, "yale.edu": 0.96,
    "github.com": 0.90, "stackoverflow.com": 0.92, "mozilla.org": 0.95, "developer.mozilla.org": 0.96, "loc.gov": 0.98, "nasa.gov": 0.97, "gutenberg.org": 0.95, "archive.org": 0.95,
    "ourworldindata.org": 0.96, "worldbank.org": 0.95, "khanacademy.org": 0.95, "ocw.mit.edu": 0.97, "mayoclinic.org": 0.97, "nhs.uk": 0.96, "scholarpedia.org": 0.95, "plato.stanford.edu": 0.97,
    "imslp.org": 0.93, "oeis.org": 0.94, "pubchem.ncbi.nlm.nih.gov": 0.96, "eol.org": 0.94, "free.law": 0.93, "law.cornell.edu": 0.95, "instructables.com": 0.88, "permies.com": 0.87,
    "openstove.org": 0.85, "freecodecamp.org": 0.91, "thespruce.com": 0.86, "familyhandyman.com": 0.86, "investopedia.com": 0.88, "zerotwothree.org": 0.92,
}

#: Misspellings and what is meant, of the batch side.
SPELLING = {
    "reciepe": "recipe", "recipie": "recipe", "recepie": "recipe", "algorith": "algorithm", "algorithim": "algorithm", "algoritm": "algorithm", "pythn": "python", "pyhton": "python", "pyton": "python",
    "javscript": "javascript", "javasript": "javascript", "javascript": "javascript", "photoShop": "photoshop", "photoshopt": "photoshop", "mathmatics": "mathematics", "mathematics": "mathematics", "matheatics": "mathematics",
    "phisics": "physics", "phsyics": "physics", "phyics": "physics", "biolog": "biology", "bilogy": "biology", "chmistry": "chemistry", "chemestry": "chemistry", "progrmming": "programming", "programing": "programming",
    "nutriton": "nutrition", "nutrtion": "nutrition", "histroy": "history", "hsitory": "history", "geoagrophy": "geography", "gography": "geography", "cokking": "cooking", "coooking": "cooking", "cramming": "learning", "grammer": "grammar",
    "enviroment": "environment", "enviorment": "environment", "sustanable": "sustainable", "sustainble": "sustainable", "democrcy": "democracy", "demoracy": "democracy", "ecosytem": "ecosystem", "ecosystm": "ecosystem",
    "renassiance": "renaissance", "renaisance": "renaissance", "diabeties": "diabetes", "diabetus": "diabetes", "antibotic": "antibiotic", "antibitocs": "antibiotics", "astronomoy": "astronomy", "astronomy": "astronomy",
    "philosphy": "philosophy", "philospher": "philosopher", "psycology": "psychology", "psycholog": "psychology", "archeology": "archaeology", "archaeolgy": "archaeology", "linguistcs": "linguistics", "linguistis": "linguistics",
    "ecnomics": "economics", "economic": "economics", "thermodynaics": "thermodynamics", "thermodyamics": "thermodynamics", "evoluton": "evolution", "evolutiion": "evolution", "newton law": "newtons laws", "newton first law": "newtons first law",
    "spaceX": "spacex", "tesla motors": "tesla", "clmate change": "climate change", "climte change": "climate change", "artifical intelligence": "artificial intelligence", "machine lerning": "machine learning", "maching learning": "machine learning",
    "deep lerning": "deep learning", "disection": "dissection", "destilation": "distillation", "centrifuge": "centrifuge", "catalist": "catalyst", "molecular": "molecular", "moleculer": "molecular", "protien": "protein", "proten": "protein",
    "vitiman": "vitamin", "vitemin": "vitamin", "hormon": "hormone", "hormomes": "hormones", "sceince": "science", "sciense": "science", "relativity": "relativity", "relativty": "relativity", "quantum mechancis": "quantum mechanics",
    "fourier transform": "fourier transform", "fourier": "fourier", "eigenvalue": "eigenvalue", "eigen value": "eigenvalue", "derrivative": "derivative", "derivitive": "derivative", "integrl": "integral", "intergral": "integral",
    "derivatve": "derivative", "differential": "differential", "trignometry": "trigonometry", "trigonometry": "trigonometry", "geometry": "geometry", "geomety": "geometry", "speleology": "speleology", "spelelogist": "speleologist",
    "mycology": "mycology", "mycolgy": "mycology", "entomology": "entomology", "entomolgy": "entomology", "botny": "botany", "botony": "botany", "zology": "zoology", "zoolog": "zoology",
}
#: The serving side has the real corrections alone, without these, and one word that it knows for right.
SERVING_SPELLING = {k: v for k, v in SPELLING.items() if k != v and k not in ("photoShop", "coooking", "astronomoy", "economic", "newton law", "newton first law", "spaceX", "tesla motors", "eigen value")} | {"astronomy": "astronomy"}
