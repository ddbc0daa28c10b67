"""Sentences written for the tests of problem 8 and taken from nowhere else.

Every second one (even position) was used to extend the lexicon, the others
(odd position) only to measure it. The clean ones are technical or factual.
"""

PROBES = {
    "abusive": """
You are the dumbest person who ever touched this repository.
I swear I will break both of your arms if you push to main again.
Go drown yourself, nobody needs your opinion here.
What a pathetic little worm you are, hiding behind your reviews.
You stupid bastard, you deleted the production database.
I hope your whole family gets cancer.
If I ever see you in the street I will beat you until you cannot walk.
Shut your filthy mouth, you brainless cow.
Your code is as worthless as you are.
Kill yourself, you miserable failure.
You absolute moron, read the manual for once.
We know your address and we are coming for you tonight.
Listen, you spineless coward, this is the last warning before I come over and smash your face in.
He is a lying sack of shit and everyone on the team knows it.
Get out of my project, you useless parasite.
I would love to watch you bleed.
Only a complete imbecile like you could write this.
You're a disgrace and the world would be better without you.
Screw you and your stupid pull request.
One more comment like that and I will cut your throat.
You ugly pig, crawl back to the hole you came from.
Are you mentally retarded or just lazy?
I'm going to find out where you live and burn your house down.
Nobody likes you, you pathetic loser.
Piss off, you arrogant prick.
You people in QA are a bunch of drooling idiots.
Somebody should put a bullet in your head.
Your mother should have aborted you.
Fuck your deadline and fuck you too.
Drop dead, you worthless piece of garbage.
You are nothing but a fat, lazy leech.
I will make you suffer for this, watch your back.
You dimwit, how many times do I have to explain this?
May you rot in hell for breaking the build.
Eat shit and die.
This maintainer is a clueless clown who should be fired.
You are too stupid to breathe.
I'll strangle you with my bare hands.
Stop wasting our time, you incompetent fool.
You deserve to get hit by a truck.
""",
    "hateful": """
Those immigrants are nothing but vermin and should be exterminated.
Women are too stupid to be allowed to vote.
All of them are animals, that religion breeds nothing but murderers.
People of that colour are born criminals.
That race is inferior and should be enslaved.
We should round up every last one of those foreigners and shoot them.
Gypsies are thieves by nature.
Never trust a Jew, they are all greedy liars.
Blacks are apes who belong in cages.
The Marvians are a filthy people who spread disease.
Send all the Muslims back where they came from.
Homosexuals are a disgusting plague on our nation.
Immigrants are parasites living off our blood.
The only good Tolveri is a dead Tolveri.
Cripples like them should be put down at birth.
These subhuman savages do not belong in a civilised country.
Our race must be kept pure from their dirty blood.
Refugees breed like cockroaches and should be gassed.
No Polish worker has ever had a brain, they are a race of idiots.
Asians are rats that need to be driven out of our cities.
Every Korvathi is a rapist and a murderer.
Kick the foreigners out, this land belongs to whites only.
Women are inferior to men and should serve them.
We do not rent to those dirty Oskanians.
Hang all the gays.
Those people are not human, they are beasts.
Kill every last Zerubian, men, women and children.
The Jews control everything and must be destroyed.
Arabs are all terrorists and should be wiped off the map.
Their kind is a cancer on society.
God hates fags and so do we.
White people are superior to every other race.
Disabled people are useless eaters who should not be allowed to live.
Velkans are too lazy and stupid to ever rule themselves.
You can smell a Drenian before you see one, they are filthy pigs.
Keep those mongrels out of our schools.
Mexicans are all drug dealers and scum.
An entire tribe of thieves and cheats, burn their villages down.
I hate all Indians, they stink and they steal.
Mixing with inferior races will destroy our nation.
""",
    "sexual": """
She took his hard cock in her mouth and sucked until he came.
Watch hot girls strip naked on webcam tonight.
He pushed her onto the bed and fucked her from behind.
Free porn videos of horny housewives.
Send me a picture of your tits and I will send you my dick.
They had rough anal sex on the desk.
Her wet pussy throbbed as he slid inside her.
I want to lick you all over until you scream.
Uncensored hardcore sex clips, adults only.
He ripped off her panties and went down on her.
She moaned as he thrust deeper into her.
Looking for a discreet hookup with a busty blonde tonight?
He came all over her breasts.
Two naked women kissing and touching each other in the shower.
I masturbated while thinking about you.
Live cam girls ready to fuck you now.
She spread her legs and begged him to take her.
Her nipples hardened under his tongue.
He unzipped his trousers and told her to get on her knees and suck.
Hot lesbian threesome with double penetration.
She rode him until they both climaxed.
Big boobs, tight asses and nonstop orgasms.
I'm so horny, come over and fuck me.
His erection pressed against her bare thighs.
The best blowjob she had ever given.
He slipped his fingers inside her and she gasped with pleasure.
Nude photos of teens, click here.
She let him ejaculate on her face.
They made love all night, naked and sweating.
Stroke my cock, baby.
He squeezed her buttocks and kissed her naked breasts.
Erotic stories about swingers and group sex.
I want you inside me right now, make me come.
She grabbed his penis and guided it into her vagina.
Get your cheap sex toys and dildos here.
He spanked her bare ass until it was red.
Sexy singles in your area want to get laid tonight.
She was dripping wet when he finally entered her.
His tongue circled her clit.
Strip for me, I want to see every inch of your naked body.
""",
    "clean": """
Kill the child process before the parent exits.
The master node aborts the slave if the heartbeat dies.
VACUUM will drop dead tuples from the table.
Drop dead letters after seven days.
The worker should kill itself if the parent pid has changed.
A dumb terminal cannot handle escape sequences.
The rape seed harvest was measured in tonnes per hectare.
Sexual reproduction in plants requires pollination.
The column sex holds M or F.
Blood type and race were recorded for every patient in the study.
The breed of dog is stored in the second field.
Racial discrimination laws were passed in the sixties.
The report describes how the regime murdered thousands of refugees.
Breast cancer screening reduces mortality.
The porn filter blocks adult sites for minors.
Garbage collection pauses kill latency.
This stupid compiler ignores the flag.
That was a dumb mistake of mine, sorry.
The parser chokes on trailing commas and dies.
Attack surface: an attacker can shoot down the connection.
We burn the image to the SD card.
The slave device pulls the line low.
Her thesis won a prize and graduated summa cum laude.
The cock valve regulates the flow of water.
Whoever wrote this crappy loop forgot to break.
The witness said the mob shouted racist slurs at the family.
Penis length of the beetle was used to identify the species.
Nipple fittings must be greased every month.
The virus kills its host within days.
Suicide prevention hotline numbers are listed below.
The troll bridge level has a pathetic frame rate.
Hit the target with two shots and beat the high score.
A parasite such as the leech feeds on its host.
The jungle kernel build is a beast.
Strip all symbols and expose the naked binary.
An idiot-proof installer is included.
The immigrants arrived in the nineteenth century and settled in the valley.
Police say the victim was beaten and stabbed.
The function returns true if the node was killed by the OOM killer.
Rats were kept in cages and fed twice a day.
""",
}

#: A second set, written after the lexicon had been extended with the first; all of
#: it was used afterwards.
MORE = {
    "abusive": """
You have the brain of a goldfish and the manners of a pig.
People like you make me want to vomit.
Go jump off a bridge, you waste of space.
I hope you get run over by a bus.
You are a complete and utter idiot.
Somebody should slap some sense into you, you clown.
Next time I see you I will knock your teeth out.
You're as useful as a chocolate teapot, you useless git.
What kind of moron writes code like this?
Nobody will cry when you are dead.
I will hunt you down and make you pay, you little rat.
Are you brain damaged or what?
You should be ashamed of yourself, you lazy bum.
Take your garbage patch and shove it up your ass.
You are the most incompetent reviewer I have ever met.
Do the world a favour and hang yourself.
I know which school your daughter goes to.
Your face makes onions cry, you ugly freak.
Why are you such a stupid bitch?
Keep talking and you will end up in a ditch.
""",
    "hateful": """
The Velorians are nothing but parasites.
All Tarskers should be deported.
We do not serve Ostrans here.
Marshlanders are lower than dogs.
The Kelm people have always been liars and thieves.
Ban all Velorians from our schools before they infect our children.
Nobody wants those dirty Ostrans living next door.
Velorian blood is dirty blood.
The world would be better without the Tarskers.
Never let your daughter marry an Ostran.
Those Marshlanders will never be civilised.
Exterminate the Kelm like the vermin they are.
Ostrans do not have souls.
A Tarsker will always stab you in the back.
Women belong in the kitchen and nowhere else.
The Velorians should be wiped from the face of the earth.
I would rather die than share a bus with an Ostran.
Every Marshlander I know is a thief.
They are not people, they are cattle.
Our country is being overrun by Tarsker filth.
""",
    "sexual": """
She knelt down and took him in her mouth.
Naughty nurse gets pounded hard by her patient.
He cupped her bare breasts and pulled her closer.
I am so wet thinking about your cock.
Meet horny women in your town tonight.
They tore off their clothes and had wild sex on the floor.
Her moans grew louder as he licked between her legs.
Click for free XXX movies and live nude girls.
He came deep inside her with a groan.
She wrapped her lips around his shaft.
Two girls making out naked in bed.
Send nudes, baby, I am hard for you.
His hand slid up her thigh and under her panties.
She screamed with pleasure as she orgasmed again and again.
Grab her by the pussy.
He bent her over the table and took her from behind.
Amateur wife swallows every drop.
I want to taste you and make you come all night.
Topless teens waiting for you on cam.
She felt his hardness against her belly and reached for his zipper.
""",
}
