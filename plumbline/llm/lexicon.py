"""The weighted lexicon of abusive, hateful and sexual language.

A weight of one or more is a case by itself; lesser weights have to meet within
a short stretch of text. Entries are general words with their inflections and
stock turns of phrase; RULES add to an entry by what stands before or behind
it: somebody addressed and an insult, a threat against somebody, a group and a
predicate that denies that its members are human. Groups may have any name.
"""

from __future__ import annotations


def plural(word: str) -> str:
    if word.endswith("y") and word[-2] not in "aeiou":
        return word[:-1] + "ies"
    return word + ("es" if word.endswith(("s", "sh", "ch", "x", "z")) else "s")


def nouns(weight: float, words: str) -> dict[str, float]:
    return {w: weight for x in words.split() for w in (x, plural(x))}


def verbs(weight: float, words: str) -> dict[str, float]:
    """Every verb with -s, -ed and -ing; a capital letter is doubled before an ending."""
    out = {}
    for x in words.split():
        v, stem = x.lower(), x.lower() + (x[-1].lower() if x[-1].isupper() else "")
        stem = stem[:-1] if stem.endswith("e") else stem
        out |= {w: weight for w in (v, plural(v), stem + "ed", stem + "ing")}
    return out


def turns(weight: float, text: str) -> dict[str, float]:
    return {t.strip(): weight for t in text.split(",") if t.strip()}


def product(weight: float, *lists: str) -> dict[str, float]:
    """Turns of one item out of each list, lists separated by commas."""
    out = [""]
    for text in lists:
        out = [f"{a} {b.strip()}".strip() for a in out for b in text.split(",")]
    return {t: weight for t in out}


_BEASTS = nouns(0.2, "fool clown pig troll coward parasite donkey maggot leech weasel cockroach rat dog monkey scum worm cow swine jerk freak disgrace embarrassment slob wretch pervert lunatic psycho savage vermin filth degenerate louse hypocrite traitor liar") | turns(0.2, "miserable failure, pathetic failure, total failure")
_INSULTS = nouns(0.5, "idiot dunce simpleton fuckup") | nouns(0.4, "loser retard slimeball sleazebag bozo doofus dork dope muppet pillock plonker twerp ninny nincompoop dunderhead neanderthal troglodyte halfbrain") | nouns(
    0.6, "moron imbecile cretin dimwit bastard jackass bitch halfwit nitwit numbskull buffoon twit dickhead prick twat wanker tosser bellend douche lowlife airhead bonehead blockhead knucklehead dolt dullard ignoramus deadbeat trottel idiota imbecil"
) | nouns(0.8, "dumbass scumbag douchebag shithead fuckwit dipshit jerkoff arsehole cocksucker crybaby dirtbag shitbag asshat asswipe turd tosspot sicko") | nouns(1, "asshole motherfucker fuckface fucktard arschloch hurensohn wichser connard gilipollas stronzo")
_SCORN = {w: 0.4 for w in "pathetic worthless brainless disgusting stinking incompetent clueless witless spineless gutless goddamn wertloser repulsive contemptible moronic idiotic imbecilic drooling mindless vile despicable loathsome cowardly insufferable wretched".split()} | {w: 0.3 for w in "useless stupid dumb ugly miserable retarded arrogant slimy lousy rotten".split()} | {"lazy": 0.2, "ignorant": 0.2, "filthy": 0.2, "fat": 0.1, "lying": 0.1}
_WORST = {w: 0.3 for w in "dumbest stupidest ugliest laziest filthiest sorriest vilest nastiest".split()} | turns(0.3, "most stupid, most pathetic, most useless, most worthless, most incompetent, most disgusting, most ignorant, most idiotic, biggest idiot, biggest fool, biggest loser")
_PROFANE = {"fuck": 0.5, "fucking": 0.4, "fucked": 0.4, "fucker": 0.7, "fuckers": 0.7, "shit": 0.4, "shitty": 0.4, "bullshit": 0.4, "crap": 0.2, "crappy": 0.2, "garbage": 0.1, "trash": 0.1, "damn": 0.2}
# Without weight: they count by the rules only.
_VIOLENCE = verbs(0, "knock kick punch slaP wring bash gouge whiP thrash") | turns(0, "cut, cuts, rip, rip out, tear, snap") | verbs(0, "kill murder strangle hurt smash break burn crush choke shoot staB gut slit torture slaughter butcher") | turns(0, "beat, beating")
_DOOM = turns(0, "die, rot, suffer, choke, burn, burns, burns down, drown, bleed, get cancer, dies, never wake up, end up dead, gets cancer, get cancer, get sick and die")
_BRAINS = turns(0.2, "more brains, more sense, more talent, more intelligence, more skill, better brain")
_LIVE = turns(0.3, "know where, knows where, find out where, found out where, find where, know which school, know which street, know which bus, know which house, know what school, know what car, know what time")
_WEAPONS = turns(0, "bullet in, bullet through, knife in, knife into, knife to, axe in, gun to, fist in, fist into, boot in")
_ENDS = turns(0, "end up in a ditch, end up in a grave, end up in hospital, end up in a coffin, end up in a body bag, end up in the river, end up in the morgue, leave in a body bag, be next")
_SICK = turns(0.3, "want to vomit, want to puke, want to throw up, want to be sick, me sick, me puke, brain damaged, braindamaged, mentally ill, mentally challenged, as useful as a")
_CRASH = turns(0, "get hit by, be hit by, run over by, get run over, struck by, get cancer, be shot, be hanged, be beaten")
_HOME = turns(0.2, "your address, your house, your home, your family, your kids, your children, your wife")
ABUSIVE = (
    _ENDS | _SICK | _VIOLENCE | _DOOM | _LIVE | _WEAPONS | _CRASH | _HOME | _WORST | _BRAINS | _BEASTS | _INSULTS | _SCORN | _PROFANE
    | product(1, "fuck, screw, damn", "you, your mother, yourself") | product(1, "fuck, bugger, sod", "off") | turns(0.7, "piss off, pisses off, pissing off")
    | product(1, "go to, rot in, burn in", "hell") | turns(0.6, "drop dead") | product(1, "go", "drown yourself, kill yourself, shoot yourself, choke yourself, burn yourself, bury yourself, fuck yourself, screw yourself, jump off a, play in traffic") | turns(1, "sack of shit, sacks of shit, bag of shit, should have aborted you, should have swallowed you, coming for you, we are coming for you, put you in the ground, put you in a grave, put you in hospital, make you bleed, make you beg") | turns(0.8, "piece of garbage, piece of trash, piece of filth, piece of crap, waste of a human") | turns(1, "go die, go hang yourself, kill yourself, killing yourself, shoot yourself, hang yourself, eat shit, kiss my ass, kiss my arse, suck my dick, up yours")
    | product(1, "shut", "your filthy mouth, your stupid mouth, your dirty mouth, your ugly mouth, your fat mouth, up you, up idiot, up moron, the fuck up, the hell up, your mouth, your face, your trap, your hole, your pie hole") | turns(0.5, "shut up")
    | product(1, "nobody, no one, noone", "would miss you, will miss you, would ever miss you, loves you, likes you, will ever love you, cares if you die") | product(0.9, "nobody, no one", "wants you, needs you, wants your, needs your, asked for your, asked you")
    | turns(1, "better off without you, better place without you, better if you were dead, never have been born, wish you were dead, wish you were never born, hope you die, i will kill you, son of a bitch, sons of bitches, piece of shit, pieces of shit")
    | product(1, "sorry, pathetic, worthless, useless, miserable", "excuse for a, piece of") | product(0.9, "waste of", "air, oxygen, skin, breath, life") | turns(0.6, "waste of space")
    | product(1, "crawl back", "under your rock, under a rock, into your hole, to your hole, under the rock") | turns(0.7, "get lost, get out of here and, do us all a favour and, do us all a favor and, do the world a favor and, do everyone a favor and")
    | turns(0.9, "you make me sick, makes me sick, you disgust me, are you deaf or, are you blind or, are you stupid or, are you retarded, choke on it, choke on your, watch your back, what is wrong with you, whats wrong with you")
    | product(0.8, "brain of a, brains of a, iq of a, intelligence of a, ugly as, dumb as, stupid as, thick as, dumber than, stupider than, smarter than") | turns(0.6, "brain dead, braindead, has no brain, have no brain, lost your mind, out of your mind")
    | product(1, "nobody will, no one will, noone will, no one would, nobody would", "cry when you, cry if you, care when you, care if you, mourn you, remember you") | product(1, "shove it, shove that, stick it, stick that, cram it", "up your") | product(0.8, "up your", "ass, arse, butt, backside")
    | turns(0.4, "ashamed of yourself, ashamed to, everybody here knows it, everyone here knows, everybody knows it, espece de, fix your damn, your mother, your mom, your mum, get a life, you will regret, you will pay, this crap, this shit, this garbage, whoever wrote this")
    | product(1, "find you and, hunt you down and", "kill you, hurt you, beat you, break your, smash your, cut your, burn your") | turns(0.2, "what kind of")
    | turns(1, "halt die fresse, halt die klappe, halt die schnauze, halts maul, verpiss dich, du arschloch, du idiot, fick dich, ferme ta gueule, ta gueule, va te faire foutre, va te faire enculer, fils de pute, nique ta mere, vete a la mierda, hijo de puta, que te jodan, eres un idiota, eres un imbecil, eres idiota, vaffanculo, figlio di puttana")
    | turns(0.6, "callate ya, callate, ferme la, maul halten, cabron, pendejo, salope, batard, pute, puta, puttana, abruti, cretino")
)
_VERMIN = nouns(0.1, "savage brute barbarian mongrel liar criminal rapist murderer terrorist scum") | {w: 0.3 for w in "vermin filth untermenschen uncivilized uncivilised".split()} | {"thieves": 0.1, "thief": 0.1, "subhuman": 0.9, "subhumans": 0.9}
_DUMB = nouns(0, "idiot moron imbecile crook beggar coward traitor")
_LITERAL = nouns(0, "rat cockroach parasite leech pig dog ape monkey animal beast pest disease plague cancer infection stain slave degenerate") | turns(0, "inferior, inferior to, lice, dirt, trash, garbage, apes, filthy pigs, dirty pigs")
_REMOVAL = {w: 0.2 for w in ("exterminated", "gassed", "lynched", "deported", "sterilized", "sterilised", "castrated", "enslaved", "driven out", "burned alive", "wiped out", "wiped off", "wiped from", "slaughtered", "beheaded", "shot on sight")}
_MOVED = turns(0, "eradicated, wiped out, put down, rounded up, thrown out, hanged, kicked out, chased out, locked up, expelled, whipped, sent back, shipped back, removed, killed, shot, treated like")
_PLACES = turns(0, "grave, graves, cage, cages, zoo, gutter, sewer, chains, prison, jail, coffin, camps, stable, stables, jungle")
# Verbs without weight, and groups that are named as such.
_KILLING = turns(0, "kill, hang, gas, shoot, burn, exterminate, lynch, behead, slaughter, castrate, sterilize, sterilise, massacre, drown, wipe out, get rid of, round up, lock up")
_DRIVING = turns(0, "ban, expel, remove, bar, clear, purge, send, ship, deport, kick, throw, drive, chase, keep, get, beat")
_HATING = turns(0.4, "i hate, we hate, i despise, i loathe, god hates, i detest, we despise, everybody hates")
_GOODS = turns(0.3, "the only good")
_BREED = turns(0, "breeds nothing but, breed nothing but, produces nothing but, produce nothing but, brings nothing but, bring nothing but, spread disease, spread diseases, spreads disease, steal our, steals our, living off our, live off our, living off the, leeching off our, taking over our, poisoning our, pollute our, polluting our, raping our, never had a brain, ever had a brain, too stupid to, too lazy to, too lazy and stupid, too primitive to, too dirty to, born criminals, born thieves, born liars, born killers, born to serve, drug dealers and, useless eaters, should serve, never be trusted, control everything, controls everything, have lower iq, not welcome here, not wanted here, be allowed to vote, be allowed to live, be allowed to breed, be allowed to exist, be allowed in, stink and, destroy our, ruining our, ruined our")
_SWARM = turns(0.3, "overrun by, overrun with, swamped by, swamped with, flooded with, flooded by, infested with, infested by, invaded by, ruined by, infect our, infecting our, contaminate our, contaminating our")
_SHUN = turns(0.2, "marry, marries, dating, date, share a bus with, share a room with, share a table with, sit next to, live next to, living next to, living next door, live next door, moving in next door, shake hands with, eat with, drink with, work with, be seen with, trust")
_WITHOUT = turns(0.2, "better without, better off without, get rid of, getting rid of, rid of, cleansed of, free of, cleaner without, safer without")
# Said of people only.
_SAID = turns(0, "lower than dogs, lower than animals, lower than pigs, lower than rats, lower than dirt, worse than animals, worse than rats, worse than dogs, never be civilised, never be civilized, cannot be civilised, cannot be civilized, be tamed, have souls, have a soul, have feelings like us, feel pain like us, stab you in the back, steal from you, rob you blind, cheat you, belong in the kitchen, belong at home, belong in chains, not people, are not people, not humans, not human, are cattle, are animals, have always been liars, have always been thieves, have always been criminals, have always been vermin, liars and thieves, thieves and liars, thieves and murderers, murderers and thieves, liars and cheats, cheats and liars, criminals and thieves, worth less than, the face of the earth, not one of us, cannot be trusted, can never be trusted, no place among us, have no honour, have no honor, have no culture, know their place, learn their place, born to serve, made to serve, bred to serve, smell like, stink like, look like apes, look like monkeys")
_REFUSED = turns(0.3, "hire, employ, rent, serve, marry, sell")
_SMELL = turns(0, "smell, stench, reek")
_SERVILE = turns(0, "fit for, fit only for, good for, useful for, suited for")
_CHEAT = turns(0, "steal, cheat, stink, lie")
_GROUP_NOUNS = "race, races, breed, people, peoples, tribe, blood, folk, stock, kind, caste"
HATEFUL = (
    _SWARM | _SHUN | _WITHOUT | _SAID | _VERMIN | _DUMB | _KILLING | _DRIVING | _HATING | _GOODS | _BREED | _LITERAL | _REMOVAL | _MOVED | _PLACES | _CHEAT | _SMELL | _SERVILE | {w: 0 for w in _REFUSED} | product(1, "inferior, filthy, dirty, stinking, subhuman, mongrel, degenerate, impure, lesser, verminous, cursed", _GROUP_NOUNS) | turns(1, "subhuman filth, subhuman scum, human filth, human vermin, subhuman vermin, master race, ethnic cleansing, racial hygiene, race war, race mixing, white power")
    | product(1, "breed like, multiply like, breeding like, multiplying like, swarm like", "rats, rabbits, flies, vermin, cockroaches, roaches, lice, insects, pigs, animals")
    | product(1, "go back to", "your country, your own country, where you came from, their own country, the jungle, africa, your cave") | product(1, "back", "where they came from, where they belong, to the jungle") | product(0.8, "send them, ship them, drive them, throw them, kick them", "back, out, all out, all back")
    | product(1, "treat them, treated, put down, shot, beaten, hunted, slaughtered, kept, caged", "like animals, like the animals they are, like dogs, like a dog, like rats, like vermin, like cattle, like slaves")
    | product(0.8, "out of our, out of my", "town, towns, country, countries, land, lands, village, villages, street, streets, school, schools, neighbourhood, neighborhood, neighbourhoods, neighborhoods, city, cities, homes, shops")
    | product(1, "thieves, liars, criminals, cheats, killers, murderers, rapists, savages, traitors, cowards", "by blood, by nature, by birth") | product(0.6, "in their", "nature, blood, genes, dna") | turns(0.6, "steal and lie, lie and steal, lie and cheat, cheat and steal")
    | product(0.8, "racial, blood, bloodline", "purity") | product(0.8, "our blood", "is clean, is pure, clean, pure") | product(0.9, "never be, will never be, are not", "our equals, equal to us, our equal, as good as us, fully human, really human, even human, human") | turns(1, "less than human, not even human, beneath us humans")
    | product(0.9, "not deserve, dont deserve, don t deserve, never deserve, not deserving of", "rights, to vote, human rights, mercy") | product(1, "not deserve, dont deserve, don t deserve, never deserve", "to live, to breathe, to exist") | product(0.6, "have no, has no, have neither", "soul, souls, culture, honour, honor, morals, conscience, brains, place here, place among us, right to live, right to exist, business here")
    | product(1, "burn the, burn down the, torch the, burn their, burn down their, torch their", "homes, houses, villages, churches, temples, mosques, shops") | turns(0.8, "to the camps, in the camps, back to the camps, gas chamber, gas chambers, to the ovens, gas them, gas the, kill them all, get rid of them all, hang them all, shoot them all")
    | product(0.6, "never hire, do not hire, dont hire, don t hire, never rent to, do not rent to, dont rent to, don t rent to, never trust, never serve, do not serve, never marry, not sell to, never sell to, refuse to serve, refuse to hire", "a, an, any, those, these, them, one of them, one of those") | turns(0.4, "do not rent to, never rent to, never hire, not hire, i despise, i loathe")
    | product(1, "the whole race is, whole race is, whole tribe is, entire race is, that race is, their race is, that whole race is, breed is, race of, tribe of", "scum, filth, vermin, a disease, a plague, a cancer, thieves, liars, animals, savages, criminals") | turns(0.8, "just savages, mud people, their filthy")
    | product(1, "race of, nation of, people of, breed of, tribe of, bunch of dirty", "idiots, beggars, cowards, parasites, dogs, pigs, rats, morons, degenerates, slaves, vermin, murderers, rapists") | product(1, "superior to, better than, above", "every other race, all other races, other races, all races, the other races, lesser races, inferior races")
    | product(1, "race, blood, bloodline, nation, people", "kept pure, be kept pure, must stay pure, must be pure, stays pure") | product(1, "inferior, lesser, lower, mongrel", "races, breeds, bloodlines") | product(0.9, "useless", "eaters") | product(1, "belongs to, land of, only for, for", "whites only, white people only")
    | product(1, "like the", "vermin they are, animals they are, dogs they are, rats they are, pigs they are, beasts they are, scum they are, filth they are, savages they are, parasites they are, criminals they are")
    # slurs
    | nouns(1, "nigger kike wetback raghead towelhead faggot sandnigger beaner tranny pikey untermensch") | turns(0.7, "gyppo, gypo, negroid, mongoloid, fag, fags, dyke, dykes, spic, spics, chink, chinks, gook, gooks, coon, coons, shemale, shemales, untermenschen")
)
_PARTS = nouns(0.4, "dick cock nipple") | nouns(0.5, "tit boob clit") | nouns(0.7, "pussy cunt dildo titty")
SEXUAL = (
    turns(0, "bottom, bottoms, came together") | _PARTS | turns(0.3, "xxx, cum, thigh, thighs, naked, undressed, sexy, moaned, moans, moaning, moan, gasped, nude, uncensored, aroused, topless") | turns(0.2, "breasts, erection, penis, vagina, genitals, buttocks, lust")
    | turns(0.6, "panties, horny, nudes, erotic, kinky, threesome, foreplay, stripper, strippers, fetish, milf, milfs, hentai, masturbation")
    | turns(0.7, "porn, porno, pornography, orgy, orgies, slut, sluts, whore, whores, orgasm, orgasms, orgasmed, climaxed, camgirl, camgirls, ejaculate, ejaculated, ejaculating, ejaculation, handjob, rimjob, bukkake, creampie, deepthroat, cumshot, cumming, erections")
    | turns(1, "blowjob, blowjobs, blow job, blow jobs, gangbang, gangbangs, uncensored porn, loud sex, hot sex, anal sex, oral sex, rough sex, wild sex, sex tape, sex tapes, phone sex, live sex, sex chat, sex cams, xxx cams, sex video, sex videos, hard cock, huge cock, wet pussy, big tits, huge tits, big cock, make you cum, made her cum, made him cum, make me cum, come in my mouth, ride my cock, sit on my face, go down on me")
    | product(1, "hardcore, anal, oral, rough, lesbian, gay, kinky, dirty, raw, steamy, passionate", "sex, fucking, porn, sex clips, sex scenes") | turns(0.8, "group sex, casual sex, cyber sex, cybersex, sex slave, sex slaves, sex party, sex parties, sex doll, sex dolls") | turns(0.6, "sex toy, sex toys, sex clips, sex clip, get laid, got laid, hardcore, hookup, hookups, busty, swingers, escort girls, call girls, double penetration, deep throat, doggy style, missionary position, naked body, naked bodies, hard on, boner, wank, wanking, wanked, jerk off, jerked off, jerking off")
    | product(1, "fucked, fucks, fucking, banged, screwed", "her from, him from, her hard, him hard, her brains, her ass, his ass, her all night, her mouth") | product(1, "thrust, thrusts, thrusting, slid, slides, slipped, plunged, pounded, pounding, rammed, pushed himself, guided it, buried himself", "into her, into him, inside her, inside him, inside me, deeper into, deep inside, deep into her, deeper inside")
    | product(1, "came, cum, cums, cumming, ejaculated, ejaculate, finished", "on her face, on his face, on her, all over, inside her, inside him, inside me, in her mouth, in his mouth, on my, on your") | turns(1, "fuck me, fucked her, fucks her, fucking her, fucked him, fucks him, make me come, made me come, make her come, made her come, want you inside me, need you inside me, cock in her, cock in his, dick in her, suck my cock, suck his cock, sucked his cock, stroke my cock, his hard cock, hard cock, throbbing cock, wet for you, ride me, rode him until, rode her until, came in her, sucked until he, begged him to take, begged her to take, begged him to fuck") | turns(0.5, "inside me, made love all, making love all, make love to, on her knees, on your knees, on his knees, unzipped his, unzipped her, unzip your, unbuttoned her, bare ass, her panties, her thong, her bra, from behind, with pleasure, so horny, dirty talk")
    | product(0.9, "big, huge, tight, perky, juicy, wet, sweet, firm, round", "boobs, tits, asses, ass, pussy, pussies, butts, booty, cocks, dicks") | product(0.8, "get, got, getting, went, go, going", "naked with, down on her, down on him, down on me, on top of her and") | product(0.8, "hot, nude, naked, horny, naughty, sexy, wild", "webcam, webcams, cam girls, cam girl, girls, guys, selfies, lesbians, couples, chicks, blonde, blondes, brunette, asians, wife") | product(0.7, "live", "sex, sex show, sex shows, cam girls, webcam girls, nude shows")
    | product(1, "lick, kiss, taste, touch, fuck", "you all over, every inch of you, every inch of your body") | product(0.8, "fuck, please, ride, suck", "you now, you tonight, you hard, you all night") | turns(0.7, "dripping wet, cam girls, cam girl, entered her, entered him, inch of your, your naked body")
    | turns(0.5, "in her mouth, in his mouth, in my mouth, in your mouth, deep inside her, deep inside him, lips around his, lips around my, hard for you, wet for, so wet, by the pussy, making out, waiting for you on, every drop, knelt down and, on top of him, on top of her, for his zipper, for his belt, between her legs, over the table and, tore off their clothes, tore off her clothes") | turns(0.7, "his shaft, his manhood, his hardness, her folds, his member, make you come, gets pounded, got pounded, getting pounded, bent her over, bent him over, send nudes, amateur wife, amateur porn, nude girls, naughty nurse, horny women, on cam, thinking about your cock, taste you") | product(0.7, "your", "cock, dick, pussy, tits, boobs") | product(0.6, "took, takes, taking", "him in her, her from, him deep, his cock, his dick")
    | {w: 0.4 for w in ("topless", "groan", "groaned", "swallows", "swallowed", "pounded", "breasts", "breast", "nipples", "bare thighs", "buttocks", "bosom", "crotch", "groin", "penis", "vagina", "lesbian", "throbbed", "throbbing", "orgasmic", "lick you", "kiss you all over", "undressed", "suck", "sucked", "sucking", "sweating", "spank", "spanked", "camgirls", "webcam girls", "adults only")}
    | verbs(0.8, "masturbate") | turns(0.4, "had sex, having sex, have sex, sex with, made love, making love, make love, undressed, begged him to, begged her to, under his tongue, under her tongue, groped, groping, licked, sucked")
    | product(0.8, "fuck, fucks, fucked, fucking, licked, licking, sucked, sucking, spank, spanked, spanking, undress, undressed", "her, me, him") | product(1, "took off, ripped off, pulled off, pulled down, slid off, slipped off, tore off", "her panties, her bra, his boxers, his underwear, her underwear, her thong")
    | product(0.8, "under, up", "her skirt, her dress, her blouse") | product(0.7, "until she, until he, until they, before she, when she, made her", "came, climaxed") | product(0.9, "spread, open, opened, between", "her legs, your legs, her thighs, his legs") | product(0.8, "strip, strips, stripping, undress, undressing, masturbate, moan", "for me, for you, live, for us, naked, on cam, on camera")
    | product(0.8, "her, his, my", "moans, nipples, tits, pussy, cock, dick, naked body, wet thighs, bare breasts, clit, hard on") | product(0.8, "naked", "women, men, woman, man, girls, boys, bodies, body, wives, teens, models, amateurs, ladies, pictures, pics, photos") | product(0.8, "send me, show me, see my, see your, suck my, lick my, want your", "nudes, dick, cock, tits, pussy, boobs, naked pictures, body naked")
    | product(0.7, "hot, horny, sexy, local, naughty, lonely, busty", "singles, girls, babes, women, milfs, housewives, wives, moms, teens, ladies") | product(0.8, "touch, touched, touching, play with, playing with, finger, fingering", "yourself, herself, himself, myself") | product(0.8, "erotic, sensual, nude", "massage, massages, photos, pictures, video, videos, stories, clips, chat") | product(0.6, "adult", "clips, videos, cams, chat, movies, entertainment, film, films, dating") | product(0.5, "happy", "ending for men, endings for men") | turns(0.3, "happy ending, live cams, adults only, 18 plus only, nsfw, in bed with")
)
#: Technical and factual uses; what overlaps with one is no hit.
EXCEPTIONS = (
    "jackass penguin", "pond scum", "hell week", "vermin control", "naked eye", "strip naked pointers", "naked pointers", "cum laude", "pussy willow", "cock valve",
    "great tits", "blue tits", "coal tits", "pathetic fallacy", "retarded potential", "dumb terminal", "lazy loading", "lazy evaluation", "useless use of cat",
    "drop dead tuples", "drop dead letters", "drop dead rows", "drop dead nodes", "drop dead connections", "drop dead code", "drop dead entries", "drop dead peers", "drop dead links", "drop dead branches", "drop dead date", "drop dead deadline", "kill yourself if", "kill yourself when", "kill yourself after", "porn filter", "porn filters", "porn blocker", "nipple fitting", "nipple fittings", "breast cancer", "breast feeding", "chicken breast", "dick tracy", "coal tit", "pig iron", "naked binary", "naked eye", "naked pointer",
    "stupid compiler", "crappy loop", "sexual reproduction", "column sex", "moby dick", "dick and jane", "filth layer", "disease rates", "sore loser of the election",
    "idiot light", "can retard", "retard the", "spark retard", "grease nipple", "grease nipples", "pipe nipple", "pipe nipples", "idiot proof", "worthless option", "bastard file", "stop cock", "weather cock", "dumb pointer", "dumb pipe", "loser tree", "winner loser", "naked pointer", "naked return", "naked singularity", "fools day", "troll bridge", "guinea pig", "guinea pigs", "apache pig", "pig latin", "garbage collector", "garbage collection", "butt joint", "butt weld", "laser stripping", "strip mining", "comic strip", "wire stripping", "dog food", "lab rat", "lab rats",
)
CATEGORIES = {"abusive": ABUSIVE, "hateful": HATEFUL, "sexual": SEXUAL}

# Cues: words with gaps between; ``a|b`` is either, ``*`` any word, ``+s`` any word in s, ``words?|`` inside an alternative a word with or without its s, ``?`` behind a word makes it optional.
_YOU = "you|u|ya|youre|thou"
_NAMED = "jews?|jewish|muslims?|christians?|hindus?|catholics?|blacks?|whites?|negroes|arabs?|asians?|africans?|mexicans?|indians?|pakistanis?|chinese|poles|polish|turks?|gypsy|gypsies|roma|gays?|homosexuals?|lesbians?|transsexuals?|women|girls|females?|cripples?|disabled|immigrants?|foreigners?|migrants?|refugees?|natives?|infidels?|fags?|heathen"
_TRIBE = "+ians|+eans|+nese|+ites|+tans|+rans|+landers|+dwellers|+vians|+kers"
_ONE = "+ian|+ean|+ite|+tan|+ran|+lander|+dweller|+ker|+nese|jew|muslim|arab|gypsy|foreigner|immigrant|refugee|migrant|mexican|indian|african"
_FOLK = "+ians|+eans|+nese|+mese|+lese|+gese|+ites|+ovans"
_BE = "are|is|were|was|re|am|r"
_PEOPLE = "they|+ers|+ans|+ians|+ites|+nese|+mese|+lese|+gese|+ish|people|folk|race|tribe|breed|immigrants|foreigners|migrants|refugees"
_HUMAN = "those|these|such|all|foreign? people|folk|race|tribe|immigrants|foreigners|migrants|refugees"
_BODY = "teeth|hands|hand|legs|leg|arms|arm|fingers|neck|skull|face|nose|bones|jaw|knees|throat|head|house|home|family|kids|children|wife|husband|mother|father|dog|guts|eyes|ribs|spine|kneecaps"
_THREAT = "i|we|ill|im|somebody|someone m|am|re|are? will|ll|gonna|shall|should|going to? *?"
_MUST = "should|must|ought|need|deserve|deserves|have|has to? all? be"
_NO_MORE = "all|just|only|nothing|little|no but|more|better|than? than|a|an|the?"
#: Category, entries that it is about, cues before, cues behind (either may be missing), what it adds to the peak.
RULES = (
    ("abusive", _INSULTS | _BEASTS, f"{_YOU} *?", None, 0.8),
    ("abusive", _INSULTS | _BEASTS, f"{_YOU} {_BE} *? *? *?", None, 0.8),
    ("abusive", _INSULTS, "your|yourself *? *? *?", None, 0.5),
    ("abusive", _INSULTS | _BEASTS, None, "like|such|of|as|are you|u", 0.8),
    ("abusive", _INSULTS, f"{_BE} a|an|such|just|all|nothing a|but? *?", None, 0.5),
    ("abusive", _INSULTS, "what|only|another|some|which|bunch|pack|kind|sort of|a|an? *?", None, 0.5),
    ("abusive", _INSULTS, "he|she|shes|hes|author|maintainer|manager|boss|whoever *? *?", None, 0.5),
    ("abusive", _SCORN, f"{_YOU} {_BE} so|such|just|really|completely|utterly|totally|all?", None, 0.7),
    ("abusive", _SCORN, _YOU, None, 0.5),
    ("abusive", _PROFANE, f"your *? {_BE} *?", None, 0.4),
    ("abusive", _VIOLENCE, _THREAT, "you|u|ya|yourself", 1),
    ("abusive", _VIOLENCE, _THREAT, f"your *? {_BODY}", 1),
    ("abusive", _DOOM, "hope|wish|pray that? you|u all? *?", None, 1),
    ("abusive", _DOOM, f"hope|wish|pray that? your {_BODY} *?", None, 1),
    ("abusive", _DOOM, "you|u all? deserve|deserves to", None, 1),
    ("abusive", _LIVE, None, "you|your|u *? live|lives|sleep|work|works|park|go|goes|play|walk|study", 0.8),
    ("abusive", _BRAINS, None, "than you|u|your|whoever|this|that|the", 0.8),
    ("abusive", _WORST, f"{_YOU} {_BE} *? *? the|a|such *?", None, 0.8),
    ("abusive", _INSULTS | _BEASTS, f"{_YOU} {_BE} *? *? *? *? *?", None, 0.8),
    ("abusive", _INSULTS | _BEASTS, f"{_YOU} *? *? *?", None, 0.6),
    ("abusive", _INSULTS | _BEASTS, "what|such a|an *? *?", "you|he|she are|is|re", 0.8),
    ("abusive", _INSULTS | _BEASTS, "useless|worthless|pathetic|stupid|brainless|miserable|spineless|filthy|fucking|lying|lazy|ugly|fat|dirty little|old|piece|fat? of?", None, 0.5),
    ("abusive", _SCORN, f"{_YOU} {_BE} too|as|nothing|so|that|all|really|just but? a|an? *? *?", None, 0.7),
    ("abusive", _SCORN, "as", "as you|your|yourself", 0.7),
    ("abusive", _SCORN, "too", "to breathe|live|exist|read|understand", 0.5),
    ("abusive", _VIOLENCE, f"{_THREAT} *? *? *? *? *? *?", f"you|your *? {_BODY}", 1),
    ("abusive", _VIOLENCE, f"{_THREAT} *? *? *? *? *?", "you|yourself", 0.8),
    ("abusive", _VIOLENCE, "watch|see|make|watching you|u", None, 0.9),
    ("abusive", _VIOLENCE, f"{_THREAT} both|all|every? of?", f"of? your *? {_BODY}", 1),
    ("abusive", _VIOLENCE, "i will|shall|would|ill|gonna", "both|all|every of your *?", 1),
    ("abusive", _VIOLENCE, "i|we will|shall|ll|would|could|swear|am|m *? *? *? *?", f"your|both *? *? {_BODY}", 1),
    ("abusive", _WEAPONS, None, f"your {_BODY}|back|chest|belly|stomach|gut", 1),
    ("abusive", _CRASH, "hope|wish|deserve|deserves|should you? to? *?", None, 1),
    ("abusive", _CRASH, "you *? deserve|should|ought to?", None, 1),
    ("abusive", _DOOM, "make|watch|see you|u", None, 1),
    ("abusive", _DOOM, f"hope|wish|pray|may that|all? you|your|u *? *? *?", None, 1),
    ("abusive", _SCORN, f"{_BE} {_YOU} *?", "or|and just|simply|also? lazy|stupid|dumb|blind|deaf|drunk|retarded|idiot", 0.5),
    ("abusive", _BEASTS, "this|that|the|our maintainer|developer|author|manager|boss|reviewer|guy|man|woman|person|editor|lead is|was *? *?", None, 0.6),
    ("abusive", _ENDS, f"{_YOU} will|ll|are|re|might|could? going|gonna? to? *?", None, 1),
    ("abusive", _SICK, f"{_YOU}|your|yourself|people *? *? *? *? *?", None, 0.7),
    ("abusive", _SICK, f"{_BE} {_YOU}", None, 0.7),
    ("abusive", _LIVE, None, "your daughter|son|kid|kids|wife|mother|family|sister|children", 0.8),
    ("abusive", _HOME, "know|found|find|have|got|i|we|burn|come to where|out|ll|will|going|gonna|to|and? to|burn|and? *? *?", None, 0.8),
    ("abusive", turns(0.6, "drop dead"), "just|go|please|should|can|you|and", None, 0.5),
    ("abusive", turns(0.6, "drop dead"), None, "you|u|and|already|asshole|idiot|moron", 0.5),
    ("sexual", turns(0, "climaxed, orgasmed, came together"), "he|she|they|we|i|both both|finally|all?", None, 0.4),
    ("sexual", turns(0, "bottom, bottoms, buttocks"), "bare|naked|spanked her|his|their?", None, 0.6),
    ("sexual", turns(0, "moaned, moans, moaning, moan, gasped"), "he|she|they|i|her|his", "as|with|when|while|softly|loudly|under he|she|his|her|they|pleasure|i", 0.8),
    ("sexual", turns(0, "masturbate, masturbated, masturbating, masturbates, made love, making love, had sex"), "i|he|she|they|you|we|while|to *?", None, 0.4),
    ("sexual", turns(0, "breasts, breast, nipples, nipple, buttocks, penis, vagina, clit, thighs, bosom, crotch, ass, bare thighs"), "kissed|squeezed|fondled|caressed|stroked|groped|cupped|licked|sucked|rubbed|touched|grabbed|kissing|licking|sucking|squeezing|stroking|spanked|spanking|over|circled|against her|his|my|your *? *?", None, 0.6),
    ("sexual", turns(0, "naked, nude, topless"), "women|girls|men|couple|lovers|body|boys|two|her|them *?", "kissing|touching|together|and|in bed|shower|moaning|each *? *? kissing|touching|sweating|moaning|other|sex?", 0.5),
    ("hateful", _VERMIN | _DUMB | _LITERAL, f"{_NAMED} *? *? {_BE} *? *? *?", None, 1),
    ("hateful", _VERMIN | _DUMB | _LITERAL, f"{_NAMED}|{_FOLK} {_BE} {_NO_MORE} *?", None, 1),
    ("hateful", _VERMIN, "every|each|any * is|are a|an|just|all|born|nothing *? *?", None, 1),
    ("hateful", _LITERAL, "breeds|breed|produces|all|of them|those|these|their|the kind|race|people|lot|of|religion? them? is|are|nothing|but a|an|just|but|all? on?", None, 1),
    ("hateful", _BREED, f"{_NAMED}|{_FOLK}|race|religion|tribe|kind|colour|color|those|these|they|+ans *? *? *? *? *?", None, 1),
    ("hateful", _BREED, "every|no|all|the +ians|+eans|+ese|+ish|+ites|+i|+an *? *? *? *?", None, 1),
    ("hateful", _REMOVAL | _MOVED, f"{_NAMED}|{_FOLK}|race|tribe|breed|religion *? *? *? *? {_MUST} *?", None, 1),
    ("hateful", _KILLING, None, f"all|every|each|those|these|the|them last|of|single|damn|one|fucking|dirty|filthy|goddamn|one? of? the|those|these? *? {_NAMED}|{_FOLK}|+ian", 1),
    ("hateful", _KILLING, "all|should|must|will|to", f"{_NAMED}", 0.6),
    ("hateful", _DRIVING, None, f"all|every|those|these|the? the|of|those|last|single|damn|fucking|dirty|filthy? *? {_NAMED}|{_FOLK}|mongrels|savages back|out|away|home|off", 1),
    ("hateful", _SWARM, None, f"all|these|those|the|dirty|filthy|foreign? *? {_NAMED}|{_TRIBE}|{_ONE}|filth|scum|vermin|savages", 0.9),
    ("hateful", _SWARM, f"all|these|those|the|them|{_NAMED}|{_TRIBE} *? *? *? *? *?", "children|women|blood|schools|youth|girls", 0.9),
    ("hateful", _SHUN, "never|not|nobody|rather die than|wants|would|dont|t let|want|wants? your|our|my|those|these|dirty|filthy? *? *? *?", f"to|with? a|an|any|one|those|these|dirty|filthy of|those? {_ONE}|{_TRIBE}|{_NAMED}", 0.9),
    ("hateful", _SHUN, f"nobody|not|dont|t|never|no wants|want|one? those|these|dirty|filthy|any dirty|filthy|of? {_TRIBE}|{_NAMED}", None, 0.9),
    ("hateful", _SHUN, "would|rather|never|rather die|starve|walk than|to", f"a|an|any|those|these {_ONE}|{_TRIBE}|{_NAMED}", 0.9),
    ("hateful", _WITHOUT, None, f"the|those|these|all|every *? {_NAMED}|{_TRIBE}|{_ONE}", 0.9),
    ("hateful", _SAID, f"{_NAMED}|{_TRIBE}|people|folk|they|those|race|tribe *? *? *? *?", None, 1),
    ("hateful", _SAID, f"a|an|every|any|no {_ONE} will|can|would|is|are|does|always|never? always|never|not|only? *?", None, 1),
    ("hateful", _VERMIN, f"every|any|each|no {_ONE} *? *? {_BE} a|an|just|but? *?", None, 1),
    ("hateful", _VERMIN | _DUMB, f"{_NAMED}|{_TRIBE}|people|folk|race|tribe have|has always|all? been *? *?", None, 1),
    ("hateful", _DRIVING, None, f"all|every|those|these|the? *? {_NAMED}|{_TRIBE} from our|this|the|my", 1),
    ("hateful", _KILLING, None, f"all|every|those|these|the? *? {_TRIBE} like|and|now|before|to", 0.9),
    ("hateful", _HATING, None, f"all|every|those|these|the|fucking|filthy|damn? {_NAMED}|{_FOLK}", 0.6),
    ("hateful", turns(0, "fag, fags, dyke, dykes, chink, chinks, gook, gooks, spic, spics, coon, coons"), "hate|hates|dirty|filthy|fucking|you|all|those|these|kill|god *?", None, 0.4),
    ("hateful", _GOODS, None, "* is|are a|the? dead", 1),
    ("hateful", _PLACES, f"{_NAMED}|{_FOLK} *? *? *? *? belong|belongs|go|be in|into|behind a|the|their?", None, 1),
    ("hateful", turns(0, "inferior, inferior to"), f"{_NAMED}|{_FOLK}|race|blood {_BE} *? *?", None, 1),
    ("hateful", _REFUSED, "never|not|dont|t|refuse to?", f"to? a|an|any|those|these|them|one? of|dirty|filthy? those|these|dirty|filthy? {_NAMED}|{_FOLK}", 0.7),
    ("hateful", _SMELL, None, f"a|an|of|from? {_NAMED}|{_FOLK}|+ian", 1),
    ("hateful", _VERMIN, f"they|them|those|these|all|every|+s {_BE} {_NO_MORE} *?", None, 1),
    ("hateful", _VERMIN, f"{_PEOPLE} *? {_BE} *? *?", None, 1),
    ("hateful", _VERMIN, "those|these|dirty|filthy|stinking|lying|thieving|bloody +s", None, 0.7),
    ("hateful", _LITERAL, f"{_HUMAN} {_BE} {_NO_MORE} *?", None, 1),
    ("hateful", _LITERAL, f"people|folk|race|tribe|breed|blood *? {_BE} {_NO_MORE} *?", None, 1),
    ("hateful", _REMOVAL, f"they|those|these|all|every|+s {_MUST}", None, 0.8),
    ("hateful", _REMOVAL, f"{_PEOPLE} *? *? {_MUST} *?", None, 0.8),
    ("hateful", _MOVED, f"{_HUMAN} *? *? {_MUST} *?", None, 1),
    ("hateful", _MOVED, f"{_PEOPLE} *? *? {_MUST} *?", "like +s|vermin|a|the|stray *?", 1),
    ("hateful", _PLACES, f"{_PEOPLE} belong|belongs in|into a|the|their?", None, 1),
    ("hateful", _PLACES, f"place|home for a|an|all|the|those|these? *? {_PEOPLE}|+er|+an|+ian|+ite is|are in? a|an|the?", None, 1),
    ("hateful", _CHEAT, f"{_PEOPLE} all|only|always|will|just always|all?", None, 0.6),
    ("hateful", _CHEAT, f"all {_PEOPLE}", None, 0.6),
    ("hateful", _VERMIN | _LITERAL, f"country|nation|town|city|village|land|street with {_PEOPLE} *? *? *? *? *? *? *?", None, 1),
    ("hateful", _SMELL, None, f"of|from? them|those|these|{_PEOPLE}", 0.6),
    ("hateful", _SERVILE, f"{_PEOPLE}|those|these {_BE} only|just|not|barely|hardly?", "scrubbing|cleaning|sweeping|serving|slavery|slaves|menial|washing|toil|digging|labour|labor|hauling", 1),
    ("hateful", nouns(0, "savage brute barbarian mongrel"), "just|mere|but|of", None, 0.9),
    ("hateful", _REFUSED, "never|not|dont|t|refuse to?", f"a|an|any|to|one|those|these of|to? those|these? +an|{_PEOPLE}", 0.5),
    ("hateful", turns(0, "i despise, i loathe"), None, f"all|every|those|these|the|that? {_PEOPLE}", 0.6),
)
