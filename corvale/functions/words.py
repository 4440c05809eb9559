"""Fixed word lists and patterns of keyword extraction."""

# Common words.
STOP_WORDS = """
a an and are as at be been by for from has have he in is it its of on that the to was will with what when where which who
why how can could should would may might must shall do does did done this these those there their them they we you your our
us am im me my i if so or but not no yes
""".split()

# Words too common in technical text.
TECHNICAL_STOP_WORDS = """
get set use using used make made create created add added remove removed update updated delete deleted need needs want wants
like example examples please help show find search look looking implement implementing implemented implementation
""".split()

# Technical terms that are always kept.
PRESERVED = """
api auth authentication authorization database db sql query queries function functions class classes method methods variable
variables array arrays object objects type types interface interfaces component components module modules package packages
library libraries framework frameworks server client request response http https rest graphql websocket async await promise
callback event events error errors exception exceptions debug debugging test tests testing unit integration e2e docker
kubernetes container containers deployment deploy git github gitlab version versions branch branches commit commits pull push
merge rebase python javascript typescript java golang rust react vue angular next nuxt express django flask postgresql
postgres mysql mongodb redis supabase aws azure gcp cloud serverless lambda jwt oauth token tokens session sessions cookie
cookies
""".split()

# Patterns in lower-cased text and the term that each adds.
COMPOUNDS = [
    (r"best\s+practice[s]?", "best_practices"),
    (r"how\s+to", "howto"),
    (r"step\s+by\s+step", "step_by_step"),
    (r"real\s+time", "realtime"),
    (r"full\s+text", "fulltext"),
    (r"full[\s-]?stack", "fullstack"),
    (r"back[\s-]?end", "backend"),
    (r"front[\s-]?end", "frontend"),
    (r"data[\s-]?base", "database"),
    (r"web[\s-]?socket", "websocket"),
]
