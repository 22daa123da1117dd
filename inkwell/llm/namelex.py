"""Fixed word lists for reading names. Operators take them as arguments; these are the defaults."""

# Given names with the short and foreign forms typed for them.
GIVEN_NAMES = {
    "abraham": "abe abram bram abm", "adam": "", "albert": "al bert", "alexander": "alec alex sandy alexr sascha", "alfred": "alf fred", "anna": "ann anne annie", "anthony": "tony anton",
    "arthur": "art", "august": "gus augustus", "benjamin": "ben benj benny", "bernard": "bernie bernhard", "caroline": "carrie carolina", "catherine": "kate cathy", "charles": "charlie chas carl karl",
    "charlotte": "lottie charl", "christopher": "chris kit", "clara": "", "daniel": "dan danl danny", "david": "dave davy", "edmund": "", "edward": "ed edw eddie ned ted", "elizabeth": "eliza beth betty lizzie liz elisabeth eliz",
    "emma": "", "ernest": "ernst", "eugene": "gene eugen", "ferdinand": "ferd", "frances": "fanny", "francis": "frank franz", "frederick": "fred freddy fredk fritz friedrich", "gabriel": "gabe gab",
    "george": "geo georg", "gustav": "gustave", "hannah": "", "harold": "harry", "helen": "helena nell", "henry": "harry hank hy heinrich hal", "herman": "hermann", "hugo": "", "isaac": "ike isaak",
    "isabella": "bella isabel", "isidore": "izzy isidor", "jacob": "jake jakob jac", "james": "jim jas jimmy", "john": "jack jno johann johnny", "jonathan": "jon jonah", "joseph": "joe jos josef joey", "joshua": "josh",
    "julia": "", "julius": "jules", "katharina": "kathe käthe kathy katharine katrina kath", "leonard": "len leo", "leopold": "leo poldi", "louis": "lou lewis luis", "louisa": "louise lulu", "ludwig": "lutz lud", "margaret": "peggy maggie meg margt greta",
    "maria": "mary marie molly", "martha": "patty", "martin": "marty", "matthew": "matt", "maximilian": "max maxim", "michael": "mike mick michl", "moritz": "maurice morris", "moses": "moe", "nathaniel": "nat nathan nate nathl nathanl",
    "nicholas": "nick nicolas nicolaus", "oscar": "oskar", "otto": "", "paul": "", "peter": "pete petr", "philip": "phil philipp", "philippa": "pippa pip", "rachel": "", "rebecca": "becky reba becca", "richard": "dick rich richd",
    "robert": "bob rob robt bert bobby", "rosa": "rose", "rudolf": "rudi rudolph", "salomon": "", "samuel": "sam saml sammy", "sarah": "sally sara", "siegmund": "sigmund", "simon": "", "solomon": "sol solly", "sophia": "sophie",
    "stephen": "steve stefan", "susanna": "susan sue", "theodore": "theo ted teddy theodor theodr", "thomas": "tom thos tommy", "tobias": "toby tobe", "valentine": "val valentin", "victor": "vic viktor", "walter": "walt wat",
    "wilhelm": "willy", "william": "will bill wm willie billy", "zacharias": "zack zach zachary zac zachariah",
}

# Words around a person's name.
TITLES = frozenset("mr mrs ms miss dr sir lady lord baron baroness count countess rev hon prof professor herr frau madame monsieur mme m. messrs capt captain col colonel gen general judge rabbi esq esquire jr sr junior senior phd md".split())
PARTICLES = frozenset("von van de der den du di da la le zu zum".split())

# Words around a family's name.
FAMILY_WORDS = frozenset("family families dynasty house clan familie famille familia haus maison".split())

# Words that show the kind of a firm.
SONS = frozenset("sons son söhne sohne fils hijos".split())
BROTHERS = frozenset("brothers bros brother gebrüder gebruder gebr freres frères hermanos".split())
COMPANY = frozenset("co company comp cie ltd limited inc corp corporation".split())
JOINING = frozenset("& and und et y".split())
BANKS = frozenset("bank banque banca banco bankhaus".split())
NATIONAL = frozenset("national nat'l natl nat".split())
SMALL = frozenset("of the at in".split())
