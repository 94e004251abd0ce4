"""The lexicon of abusive language, as plain text: classes of words and rules over classes.

Words are written as they are read after folding: lower case, no accents, no
apostrophes, hyphens as blanks. A class is a set of words with one part to play;
a rule is a sequence of items, each a word or a class (upper case) or several
joined by ``|``. ``?`` after an item means it may be missing, ``*`` up to three of
it or none, ``+`` one to three; ``_`` is up to three free words, ``__`` up to six;
``^`` and ``$`` are the ends of a passage. NAME stands for a capitalised word that
is neither in the lexicon nor an ordinary word, such as the name of a people.

The words come from general knowledge of the languages, by severity and part:
words that are abuse in themselves (STRONG, SLUR), insults that need somebody they
are aimed at (INSULT, BEAST), what makes a phrase degrading (VILE), victims,
violence, bodies. What a corpus says in its own idiom is learned from its labels
(``abuse.learn_phrases``), not listed here.
"""

CLASSES: dict[str, str] = {
    # ---- English
    "STRONG": "fuck fucker fuckers fuckwit motherfucker motherfuckers fuckface fuckhead arsehole arseholes asshole assholes "
    "dickhead dickheads scumbag scumbags wanker wankers tosser tossers twat twats cunt cunts bellend bellends shithead shitheads "
    "shitbag shitface dipshit dumbass jackass knobhead douchebag bastard bastards cretin cretins imbecile imbeciles moron morons "
    "cocksucker bullshit horseshit shite shit shits pisshead tits titties blowjob handjob gangbang cumshot",
    "FUCKING": "fucking fuckin motherfucking bloody sodding goddamn goddamned",
    "SLUR": "retard retards spastic spastics faggot faggots fags nigger niggers kike kikes spic wetback chink gook gooks "
    "raghead towelhead tranny trannies mongoloid untermensch subhuman subhumans halfbreed halfbreeds",
    "INSULT": "idiot idiots halfwit halfwits nitwit nitwits dimwit dimwits numbskull blockhead bonehead fathead simpleton "
    "simpletons dunce dolt oaf buffoon ignoramus lunatic psycho degenerate degenerates lowlife lowlifes prick pricks pillock "
    "prat plonker slob slag slut sluts whore whores hag crone harlot strumpet bitch bitches pervert perverts creep creeps "
    "weirdo scoundrel scoundrels rascal crook crooks swindler thug thugs coward cowards liar liars traitor traitors hypocrite "
    "fraud parasite parasites scum filth turd turds dung dunghill swine cur wretch lickspittle bootlicker windbag dullard "
    "nincompoop fool fools dummy loser losers freak freaks cripple cripples waster failure witch fatso lardarse wimp clown clowns puppet lackey thief thieves",
    "BEAST": "pig pigs cow sow toad toads rat rats worm worms maggot maggots leech leeches weasel weasels snake snakes dog dogs "
    "jackal vulture vultures louse goat donkey ass mule slug slugs hyena ape apes monkey monkeys baboon turnip cabbage vegetable "
    "goose chicken sheep skunk cockroach creature animal piece lump bag sack excuse waste",
    "VILE": "stupid dumb dim witless brainless mindless gutless spineless toothless worthless useless pathetic disgusting revolting "
    "repulsive slimy greasy smelly stinking stinky filthy dirty foul rotten lousy vile miserable wretched snivelling grovelling "
    "sniveling lying thieving crooked cheating drunken cowardly treacherous fat ugly bald thick idiotic moronic imbecilic cretinous "
    "witted half dimwitted damned damn bloody fucking goddamn sodding old little poor degenerate perverted inbred two faced senile "
    "demented deranged sewer gutter bloated lazy ignorant contemptible despicable loathsome putrid shitty crappy",
    "HARSH": "stupid witless brainless mindless gutless spineless worthless pathetic disgusting revolting repulsive slimy greasy "
    "smelly stinking filthy rotten lousy vile wretched snivelling sniveling grovelling thieving lying drunken cowardly treacherous idiotic "
    "moronic imbecilic cretinous dimwitted witted fucking goddamn sodding inbred senile demented contemptible despicable loathsome putrid "
    "ugly fat shitty miserable",
    "MUCK": "shit shite crap filth dung piss garbage trash scum slime",
    "YOU": "you ya youre yer yourself u", "YOUR": "your ur", "HE": "he she hes shes him her", "HISHER": "his her", "THEY": "they theyre them",
    "TITLE": "mr mrs ms miss dr sir lord herr frau monsieur madame", "PERSON": "member minister gentleman lady secretary speaker senator deputy man woman fellow mayor president chairman colleague",
    "A": "a an the such", "BE": "is are was were be am being remain remains", "ADV": "just only nothing but really truly all always so such quite simply "
    "still absolute absolutely complete completely utter utterly total totally real such and",
    "MODAL": "will would shall should must ought going gonna want wants wanted gotta could can to deserve deserves need needs have hope wish ill well",
    "KILL": "kill kills murder shoot stab strangle hang lynch drown gut skin knife behead throttle garrotte butcher slaughter "
    "strangled shot stabbed hanged hung drowned lynched murdered killed gutted beheaded",
    "HURT": "smash break bust shatter crush crack snap rip tear slit cut slash gouge bash beat kick punch knock burn torch crack split "
    "smashed broken kicked wring twist chop saw hack blow stamp stomp thrash flog whip",
    "BODY": "kneecaps kneecap knees neck legs leg teeth skull skulls face bones bone jaw throat throats head heads arms arm fingers ribs nose spine guts "
    "eyes eye ears tongue back brains hands hide",
    "KIN": "children child family wife husband kids daughter daughters son sons mother house home car",
    "SEXBODY": "tits boobs breasts titties arse ass bum cunt pussy dick cock prick penis nipples knickers panties bra thighs bottom backside crotch",
    "CLOTHES": "blouse skirt dress shirt trousers clothes top knickers panties bra underwear pants stockings",
    "UNDRESS": "undress strip unbutton naked nude topless",
    "LEWD": "horny moaning moan groping grope groped spank spanked spanking orgasm orgasms erection boner hardon humping screwing shagging "
    "shag wank wanking masturbate masturbating blowjob fellatio cum cumming slutty lick licking suck sucking fondle fondling lap mounted mount",
    "PEOPLE": "women girls wives immigrants migrants foreigners refugees muslims jews christians catholics protestants arabs africans "
    "asians blacks whites gypsies roma gays homosexuals lesbians queers cripples disabled deaf blind heathens infidels peasants "
    "southerners northerners easterners westerners natives immigrant foreigner refugee muslim jew arab african gypsy homosexual tribe tribes race "
    "beggars minorities newcomers strangers lame feeble crippled",
    "THOSE": "these those all every most any no such the", "FOLK": "people folk folks lot kind sort scum breed creatures ones tribe race families family men leute gens",
    "ANIMALS": "mice mouse rat rats rabbits rabbit crow crows fox foxes wolf wolves badgers moles weevils weevil locusts pigeons starlings "
    "beetles moths flies lice ticks fleas cockroaches termites ants wasps squirrels magpies boars cattle",
    "DEHUMAN": "vermin parasites parasite cockroaches cockroach rats lice animals beasts savages barbarians subhuman subhumans apes monkeys "
    "pigs swine leeches scum filth dirt disease plague pestilence cancer tumour tumor infection curse pests dogs mongrels rabble trash "
    "garbage dung maggots locusts degenerates abomination mistake infestation",
    "CRIME": "liars thieves criminals cheats murderers rapists swindlers crooks beggars traitors robbers scroungers whores",
    "ELIM": "exterminated eradicated sterilised sterilized gassed shot hanged drowned burned burnt deported expelled eliminated purged "
    "annihilated killed slaughtered drowned castrated whipped flogged caged lynched culled removed",
    "ELIMV": "exterminate eradicate sterilise sterilize gas shoot hang drown deport expel purge annihilate kill slaughter castrate lynch cull",
    "PEN": "wire cage cages camp camps chains zoo jungle gutter sewer kitchen stove cradle stable sty caves swamp trees",
    "NOT": "not never isnt arent dont cannot neither hardly nobody kein keine keinen nicht nie pas jamais aucun не ні ніколи",
    "TRAIT": "brain brains wit wits intellect intelligence charm manners morals spine backbone looks smell stench personality grace honesty courage warmth",
    # words that report offensive language rather than use it
    "REPORT": "quote quotes quoted quoting minutes word words phrase phrases term terms remark remarks expression offensive "
    "unparliamentary withdraw withdrawn insult insults slur slurs reported prosecuted convicted hatred leaflet graffiti "
    "slogan slogans condemn condemned condemns abhor deplore zitat zitiere wort worte beleidigung protokoll citation cite citer mot mots "
    "insulte цитую слово слова образа протокол",
    # names and words one slip from a term, which the vocabularies lack
    "ORDINARY": "salome cretan cretans moroni myron morin tweet fetzen",
    # verbs that report, if they come before
    "SAID": "called calling calls call says said saying claim claims claimed wrote written shouted painted chanted alleged allegedly accused "
    "accuses nannte nennt sagte sagt qualifie dit назвав називає казав каже",
    # ---- German
    "STARK": "arschloch arschlocher hurensohn schlampe fotze wichser vollidiot vollidioten drecksau drecksack schweinehund mistkerl "
    "scheisskerl scheisse scheiss arschgesicht dreckskerl missgeburt schlappschwanz hackfresse arsch titten ficken fick verfickt "
    "hohlkopf dummkopf schwachkopf trottel nutte pissnelke",
    "SCHIMPF": "idiot idioten schwein sau hund ratte sack depp lump schuft penner esel affe kuh ziege wurm luder hexe lugner feigling "
    "verrater gauner halunke versager parasit abschaum dreck mist kerl",
    "UBEL": "widerlicher widerliches widerliche fetter fettes fette feiger feiges feige hirnloser hirnloses hirnlose verlogener verlogenes "
    "verlogene elender elendes elende dreckiger dreckiges dreckige dummer dummes dumme mieser mieses miese blodes bloder blode "
    "stinkender stinkendes hasslicher hassliches ekelhafter ekelhaftes verdammter verdammtes fauler faules verfluchter alter dumm",
    "DU": "du dich dir sie ihr euch ihnen", "DEIN": "dein deine deinen deiner ihre ihren euren eure ihr", "SEIN": "ist sind bist seid war waren",
    "EIN": "ein eine einen so solch", "UNTER": "ungeziefer ratten parasiten schmarotzer abschaum dreck tiere untermenschen pest seuche gesindel pack "
    "krankheit vieh schweine hunde", "TAT": "brechen einschlagen ausschlagen anzunden umdrehen abschneiden aufschlitzen zertreten umbringen "
    "toten erschiessen erschlagen aufhangen ersaufen erwurgen verbrennen polieren", "LEIB": "knochen zahne hals genick kehle schadel nase beine haus fresse kopf "
    "kniescheiben",
    "WEG": "vergast erschossen gehangt ausgerottet vernichtet vertrieben gejagt abgeschoben verjagt ersauft aufgehangt", "BLOSS": "nackt nackten "
    "titten arsch brust bruste bluse hoschen schenkel rock", "MAUL": "maul fresse schnauze klappe",
    # ---- French
    "FORT": "connard connards connasse conne connes salaud salauds salope salopes ordure ordures encule encules pute putes putain batard bâtard "
    "batards merde bordel couille couilles enfoire enfoires abruti abrutie abrutis pourriture trouduc",
    "INJURE": "con porc cochon cretin imbecile idiot idiote chien chienne rat vermine parasite lache menteur traitre voleur minable ane singe pourri raclure "
    "debile clown ordure", "SALE": "sale sales espece gros grosse vieux vieille pauvre petit petite stupide puant immonde miserable infect", "TU": "tu te toi vous tes etes es netes nes",
    "TON": "ton ta tes votre vos", "ETRE": "est sont es etes etait etaient", "UN": "un une des de la le les quun quune que du",
    "NUISIBLE": "vermine parasites rats cafards betes animaux sauvages sous-hommes peste maladie cancer poux porcs chiens voleurs barbares", "ACTE": "casser briser trancher "
    "bruler crever egorger tuer etrangler pendre noyer arracher fracasser peter abattre ecraser", "CORPS": "dents gorge jambes os crane cou gueule tete "
    "maison yeux bras nez genoux", "CHASSER": "chasse chasser jette jeter expulse expulser extermine exterminer pende pendre brule bruler noie noyer elimine "
    "eliminer", "NU": "nue nu seins cuisses fesses chemisier jupe culotte cul chatte bite", "MONTRE": "montre montrez enleve enlevez ecarte ecartez suce sucez baise leve "
    "deshabille",
    # ---- Ukrainian
    "ЛАЙКА": "покидьку покидьок бовдуре бовдур виродку виродок сволото сволота мерзотнику мерзотник гівно лайно курво курва шлюхо шлюха "
    "падлюко падлюка дебіле дебіл ідіоте ідіот кретине кретин придурку придурок тварюко недоумку недоумок гнидо гнида мудаку мудак сука суко хвойдо",
    "ЗВІР": "свиня свине свинюко собако пес щуре щур осле осел козел козле черв'як черваче хробаче жабо бидло тварина тварино скотино скотина дурню дурень дурнику боягузе брехуне "
    "злодію зраднику нездаро паразите хвосте", "ГИДКИЙ": "нікчемний нікчемна тупий тупа брудний брудна свинячий смердючий смердюча огидний огидна жалюгідний підлий підла "
    "мерзенний дурний дурна гидкий потворний товстий паршивий гнилий безмозкий безхребетний продажний", "ТИ": "ти ви тобі вам тебе вас", "ТВІЙ": "твої твою твій твоя твого ваші вашу ваш",
    "НЕЛЮДЬ": "паразити нечисть нелюди щури тварини худоба зараза чума сміття бидло таргани воші гниль покидьки шкідники", "ГЕТЬ": "вигнати гнати знищити винищити вирізати "
    "вистріляти повісити спалити депортувати викинути", "БИТИ": "вбити вбю уб'ю убю зламати зламаю виб'ю вибю вибити переламати перерізати переріжу спалити спалю задушити "
    "застрелити прибити закопати", "ТІЛО": "зуби зуб шию горло ноги кістки ребра череп хату будинок дім голову руки", "ПЕЛЬКА": "пельку рота пащу писок горлянку",
    "ГОЛА": "гола голу груди цицьки дупу ноги спідницю блузку сідниці",
}

# Words that are abuse alone are insults too.
for _insults, _alone in (("INSULT", "STRONG"), ("SCHIMPF", "STARK"), ("INJURE", "FORT")):
    CLASSES[_insults] += " " + CLASSES[_alone]

RULES: list[tuple[str, float, str]] = [
    # ---- insults to a person
    ("insult", 1.0, "STRONG"),
    ("insult", 1.0, "YOU ADV* A? VILE* INSULT"),
    ("insult", 1.0, "YOU VILE+ BEAST"),
    ("insult", 1.0, "YOU HARSH+ VILE* NAME|PERSON|$"),
    ("insult", 1.0, "YOU ADV* BE? NOT? ADV* A? VILE* INSULT"),
    ("insult", 1.0, "YOU|HE|NAME|PERSON BE ADV* A VILE* BEAST $"),
    ("insult", 1.0, "YOU BE? ADV* A? VILE+ BEAST"),
    ("insult", 1.0, "HE|NAME|PERSON BE ADV* A VILE+ INSULT|BEAST"),
    ("insult", 1.0, "HE|NAME|PERSON BE ADV* A idiot|halfwit|nitwit|dimwit|scum|filth|whore|slut|bitch|prick|pervert|creep|degenerate|lowlife"),
    ("insult", 1.0, "YOU BE|look|sound|smell|stink ADV* HARSH"),
    ("insult", 1.0, "^ A? VILE* INSULT $"),
    ("insult", 1.0, "^ HARSH|VILE+ BEAST $"),
    ("insult", 1.0, "^ YOU BEAST $"),
    ("insult", 1.0, "HARSH VILE* INSULT"),
    ("insult", 1.0, "VILE HARSH VILE* INSULT|BEAST"),
    ("insult", 1.0, "what|such A HARSH+ VILE* BEAST|INSULT"),
    ("insult", 1.0, "get|take|throw that|this VILE* INSULT|BEAST out of|away"),
    ("insult", 1.0, "what|such A VILE* idiot|halfwit|nitwit|dimwit|scum|whore|slut|prick|bitch|pervert|oaf|buffoon|lowlife"),
    ("insult", 1.0, "what A HARSH+ _ YOU|HE BE"),
    ("insult", 1.0, "only A VILE* INSULT|BEAST like|would|could"),
    ("insult", 1.0, "INSULT like YOU|HE"),
    ("insult", 1.0, "son|daughter|spawn of A VILE* INSULT|BEAST|STRONG"),
    ("insult", 1.0, "bag|lump|piece|sack|pile|heap of VILE* MUCK"),
    ("insult", 1.0, "YOU|HE|PERSON BE? so? full of VILE* MUCK"),
    ("insult", 1.0, "full of shit|crap"),
    ("insult", 1.0, "YOU|HE BE? ADV* bag|lump|piece|sack|pile|heap of MUCK"),
    ("insult", 1.0, "YOU MUCK of|$"),
    ("insult", 1.0, "FUCKING VILE* INSULT|BEAST|disgrace|joke|liar"),
    ("insult", 1.0, "fuck|screw|sod|bugger|piss|damn YOU|off"),
    ("insult", 1.0, "go to hell"),
    ("insult", 1.0, "drop dead"),
    ("insult", 1.0, "get stuffed"),
    ("insult", 1.0, "up yours"),
    ("insult", 1.0, "kiss|lick my SEXBODY"),
    ("insult", 1.0, "rot in hell"),
    ("insult", 1.0, "go and? choke|die|drown|hang on|yourself|in|now|$"),
    ("insult", 1.0, "YOU born _ HARSH|dumb|stupid|ugly"),
    ("insult", 1.0, "shove|stick|stuff __ up YOUR SEXBODY"),
    ("insult", 1.0, "would not|wouldnt piss|spit on"),
    ("insult", 1.0, "shut YOUR VILE* mouth|trap|gob|face|hole|cakehole"),
    ("insult", 1.0, "YOU make|makes me|us|everyone sick|vomit|puke|retch"),
    ("insult", 1.0, "TRAIT of A _ BEAST|ANIMALS|drain|sewer|toilet|corpse|brick|plank|flea|gnat|jellyfish|doorknob|potato|pigsty|cesspit"),
    ("insult", 1.0, "face like A"),
    ("insult", 1.0, "dropped _ as A baby|child"),
    ("insult", 1.0, "YOUR|HISHER own family|mother|children|wife|dog cannot|cant|couldnt|can stand|bear|abide YOU|HE|not"),
    ("insult", 1.0, "YOUR|HISHER own family|mother|children|wife|dog cannot|cant stand|bear YOU|HE"),
    ("insult", 1.0, "smells|stinks|stink|smell so|like|of strongly|BEAST|MUCK|dung|sewer|drain"),
    ("insult", 1.0, "HE|YOU|NAME|PERSON reeks|reek|stinks|stink"),
    # ---- threats
    ("threat", 1.0, "MODAL _ KILL YOU"),
    ("threat", 1.0, "someone|somebody|i|we|they MODAL have? KILL HE|YOU|NAME|TITLE|PERSON"),
    ("threat", 1.0, "YOU|HE|NAME|PERSON should|must|ought|deserve|deserves to? have? be|been? KILL"),
    ("threat", 1.0, "HURT|KILL YOUR VILE* BODY|KIN"),
    ("threat", 1.0, "i|we|ill|well MODAL? _ HURT|KILL HISHER VILE* BODY|KIN"),
    ("threat", 1.0, "HURT YOU to|into pieces|death|pulp|bits"),
    ("threat", 1.0, "HURT|KILL every|each|all bone|bones in YOUR|HISHER body"),
    ("threat", 1.0, "put|stick A bullet|knife|blade in|into|through YOU|YOUR|HISHER|NAME|TITLE|HE"),
    ("threat", 1.0, "knock|kick|punch|smash|bash YOUR VILE* BODY"),
    ("threat", 1.0, "set YOUR VILE* KIN|BODY on fire|alight"),
    ("threat", 1.0, "set fire to YOUR"),
    ("threat", 1.0, "come|coming|came for YOUR VILE* KIN"),
    ("threat", 1.0, "run|mow YOU over|down"),
    ("threat", 1.0, "beat|thrash|flog|whip|bash YOU _ senseless|bloody|blue|up|death|pulp"),
    ("threat", 1.0, "kill|hang|shoot|drown yourself|yourselves"),
    ("threat", 1.0, "know|knows|remember where|which _ YOU live|lives|sleep|drive|walk|park"),
    ("threat", 1.0, "know|knows where YOUR KIN|live|lives|school|go"),
    ("threat", 1.0, "watch YOUR back"),
    ("threat", 1.0, "YOU _ with no|without BODY"),
    ("threat", 1.0, "put|bury YOU _ ground|grave|six|alive|hospital|wheelchair"),
    ("threat", 1.0, "dance|spit|piss on YOUR grave"),
    # ---- demeaning a group
    ("group", 1.0, "SLUR"),
    ("group", 1.0, "PEOPLE|THEY|NAME|FOLK _ BE ADV* A? VILE* DEHUMAN"),
    ("group", 1.0, "BE ADV* born|natural CRIME"),
    ("group", 1.0, "PEOPLE|NAME BE all CRIME"),
    ("group", 1.0, "all|these|those|most|the PEOPLE|NAME BE ADV* CRIME"),
    ("group", 1.0, "PEOPLE|NAME _ MODAL to? be put down"),
    ("group", 1.0, "PEOPLE|NAME BE too HARSH|dumb|weak|stupid to"),
    ("group", 1.0, "PEOPLE|THEY|NAME|FOLK breed|multiply|reproduce|swarm|spread like DEHUMAN|ANIMALS|BEAST"),
    ("group", 1.0, "breed|multiply|reproduce like DEHUMAN|ANIMALS"),
    ("group", 1.0, "PEOPLE|THEY|NAME|FOLK MODAL to? be ELIM"),
    ("group", 1.0, "PEOPLE|NAME|FOLK __ MODAL to? be ELIM"),
    ("group", 1.0, "PEOPLE|THEY|NAME|FOLK deserve|deserves to? be? die|starve|hang|rot|suffer|nothing|KILL|ELIM"),
    ("group", 1.0, "let|leave them|THOSE PEOPLE|FOLK|NAME? starve|drown|rot|burn|freeze|hang"),
    ("group", 1.0, "let them starve|rot|drown|hang|freeze"),
    ("group", 1.0, "PEOPLE|THEY|NAME|FOLK _ belong|belongs|fit|ought|should __ PEN"),
    ("group", 1.0, "belong|belongs|belonging behind|in _ bars|wire|cages|camps|gutter|sewer|zoo"),
    ("group", 1.0, "PEOPLE|THEY|NAME|FOLK have|has _ no|more soul|souls|honour|conscience|brains|shame"),
    ("group", 1.0, "no more|less soul|brain|brains|honour|conscience than ANIMALS|BEAST|DEHUMAN"),
    ("group", 1.0, "PEOPLE|THEY|NAME|FOLK _ steal|steals|rob|robs|rape everything|whatever|anything|all"),
    ("group", 1.0, "PEOPLE|THEY|NAME|FOLK cannot|cant|can _ be civilised|civilized|tamed|trusted|housetrained"),
    ("group", 1.0, "cannot|cant|never be civilised|civilized|tamed"),
    ("group", 1.0, "PEOPLE|THEY|NAME|FOLK BE not|never|hardly|less|no people|human|humans|persons|than like? us|human?"),
    ("group", 1.0, "PEOPLE|THEY|NAME|FOLK BE not|never people|human|humans"),
    ("group", 1.0, "mistake|error|accident|abomination of nature|god|creation"),
    ("group", 1.0, "drive|chase|hunt|throw|kick|run THOSE? PEOPLE|THEY|NAME FOLK? out|into|back|away"),
    ("group", 1.0, "send|ship|throw|put|kick every|all|those|these|THOSE __ back|sea|boat|boats|home where|across|over|$"),
    ("group", 1.0, "ELIMV THOSE? PEOPLE|THEY|NAME"),
    ("group", 1.0, "too many of? THOSE? PEOPLE|FOLK"),
    ("group", 1.0, "poison|poisoned|poisoning|defile|pollute|corrupt|infect|taint|rape our wells|blood|daughters|women|race|children|nation"),
    ("group", 1.0, "disease|cancer|plague|tumour|infection|rot|stain in|on|upon the|our body|face _ nation|country|people|society|land"),
    ("group", 1.0, "cleaner|better|safer|purer without them|THOSE|PEOPLE|NAME PEOPLE|NAME|FOLK?"),
    ("group", 1.0, "cleaner|purer without them"),
    ("group", 1.0, "burn|raze|torch _ their mosques|mosque|churches|temples|synagogues|homes|houses|prayer|shrines|villages"),
    ("group", 1.0, "women|woman|girls|wife|wives belong|belongs|ought|should|must|back|stay __ PEN"),
    ("group", 1.0, "thinking|voting|politics|work|brains BE not|no|too __ women|woman|girls|them"),
    ("group", 1.0, "filth|dirt|disease|crime|lice wherever|everywhere they|THOSE"),
    ("group", 1.0, "cannot|cant|never teach|trust|civilise|tame A NAME|PEOPLE"),
    ("group", 1.0, "no NAME|PEOPLE MODAL ever be? allowed|permitted|trusted"),
    ("group", 1.0, "only good NAME|PEOPLE BE A? dead"),
    ("group", 1.0, "filthy|dirty|stinking|thieving|lazy|damned|bloody PEOPLE|NAME"),
    # ---- sexually explicit or lewd
    ("sexual", 1.0, "spread|open|part YOUR|HISHER VILE* legs|thighs|knees"),
    ("sexual", 1.0, "HISHER|YOUR legs open|apart|spread"),
    ("sexual", 1.0, "make|have|hear|get|making YOU|HE _ moan|moaning|scream|naked|wet|horny"),
    ("sexual", 1.0, "want|see|seen|saw|caught|found|picture|imagine YOU|HE naked|nude|topless|undressed|moaning"),
    ("sexual", 1.0, "YOU|HE|NAME|PERSON __ caught|seen|found|spotted naked|nude"),
    ("sexual", 1.0, "take|pull|rip|get|tear|open|unbutton|drop|lift|lose YOUR|that|HISHER VILE* CLOTHES off|down|up|$"),
    ("sexual", 1.0, "take|pull|rip|tear off? YOUR|HISHER CLOTHES"),
    ("sexual", 1.0, "open|unbutton|lift|raise that|YOUR CLOTHES"),
    ("sexual", 1.0, "show|flash me|us YOUR VILE* SEXBODY|legs|CLOTHES"),
    ("sexual", 1.0, "up|down|inside|under YOUR|HISHER CLOTHES"),
    ("sexual", 1.0, "sit|come|climb|bounce on my lap|face|knee|cock|dick"),
    ("sexual", 1.0, "bend over|down A|that|this|for|my|and|$"),
    ("sexual", 1.0, "on YOUR knees __ mouth|suck|lick|good"),
    ("sexual", 1.0, "YOUR|HISHER mouth BE? _ good for"),
    ("sexual", 1.0, "suck|lick|ride|stroke|touch my|HISHER|YOUR VILE* SEXBODY"),
    ("sexual", 1.0, "with|HISHER|my|YOUR cock|dick|pussy|cunt"),
    ("sexual", 1.0, "get|got|gets|makes|getting|me hard|horny|wet|stiff every|when|whenever|for|looking|watching|thinking|just"),
    ("sexual", 1.0, "wet and|for begging|me|YOU|more|ready"),
    ("sexual", 1.0, "nice|lovely|great|gorgeous|juicy|sweet pair? of? SEXBODY|legs"),
    ("sexual", 1.0, "like|likes|love|loves|wants|needs to? be|being|A? spanked|spanking|whipped|tied|mounted|shagged|fucked"),
    ("sexual", 1.0, "BE|caught|seen|and LEWD each|one|HE|YOU|in|on|under|all|behind|against|over"),
    ("sexual", 1.0, "having it off|away"),
    ("sexual", 1.0, "at it like"),
    ("sexual", 1.0, "dog|bitch|dogs|cow|mare in heat"),
    ("sexual", 1.0, "HISHER|YOUR CLOTHES down|off|undone|open|around|round"),
    ("sexual", 1.0, "tight skirt|blouse|dress|little"),
    ("sexual", 0.6, "hey|hello|oi|here gorgeous|darling|sexy|sweetheart|babe"),
    ("sexual", 1.0, "fuck|shag|screw|bang|mount YOU|HE|my|YOUR"),
    ("sexual", 1.0, "lying|lies|lay on HISHER back _ CLOTHES|naked|legs|moaning|for|with"),
    # ---- German
    ("insult", 1.0, "STARK"),
    ("insult", 1.0, "DU UBEL* SCHIMPF"),
    ("insult", 1.0, "UBEL+ SCHIMPF"),
    ("insult", 1.0, "bist|seid|sind sie? doch|ja|so|nur? EIN UBEL* SCHIMPF|UBEL"),
    ("insult", 1.0, "bist|seid EIN? UBEL* SCHIMPF|UBEL"),
    ("insult", 1.0, "halt|halten|haltet sie? DEIN|das|den MAUL"),
    ("insult", 1.0, "halt _ MAUL"),
    ("insult", 1.0, "leck|leckt mich am"),
    ("insult", 1.0, "verpiss|verpisst dich|euch"),
    ("insult", 1.0, "fahr zur holle"),
    ("threat", 1.0, "DU den|die|das|alle LEIB TAT"),
    ("threat", 1.0, "DEIN LEIB TAT"),
    ("threat", 1.0, "schlage|schlag|schlagen|breche|brechen|haue|schneide|drehe dir|euch|ihm|ihr die|den|das|alle LEIB"),
    ("threat", 1.0, "werde|werden|sollte|sollten|wir|ich _ dich|euch TAT"),
    ("group", 1.0, "PEOPLE|NAME|FOLK|die|alle|diese|das _ SEIN alle|doch|nur|nichts|als? UNTER"),
    ("group", 1.0, "vermehren sich wie die? UNTER|kaninchen"),
    ("group", 1.0, "NAME|PEOPLE|FOLK|die|sie|diese __ gehoren|gehort|mussen|sollten|muss __ WEG|wand|stacheldraht|lager|kafig|zoo|meer"),
    ("group", 1.0, "aus dem land WEG"),
    ("group", 1.0, "haben|hat keine seele|ehre|kultur|hirn"),
    ("group", 1.0, "geborene|geborener diebe|lugner|betruger|verbrecher"),
    ("group", 1.0, "liegt _ im blut"),
    ("sexual", 1.0, "zieh dich|die|deine _ aus"),
    ("sexual", 1.0, "zeig|zeigt|zeige uns|mir|mal DEIN BLOSS"),
    ("sexual", 1.0, "zeig uns|mir DEIN nackten BLOSS"),
    ("sexual", 1.0, "mach|spreiz|spreizt die|deine beine|schenkel breit|auseinander|$"),
    ("sexual", 1.0, "auf meinen schoss"),
    ("sexual", 1.0, "nackten arsch|brusten|titten"),
    # ---- French
    ("insult", 1.0, "FORT"),
    ("insult", 1.0, "SALE+ de? INJURE"),
    ("insult", 1.0, "TU ETRE? UN? UN? SALE* INJURE"),
    ("insult", 1.0, "ferme|fermez|ta TON gueule|bec|clapet"),
    ("insult", 1.0, "va|allez te|vous|au faire|diable"),
    ("insult", 1.0, "tu|vous me degoute|degoutes|degoutez"),
    ("insult", 1.0, "fils|fille de pute|chien|chienne|porc|salope"),
    ("threat", 1.0, "TU|on|vais|va te|vous ACTE UN|TON CORPS|dents"),
    ("threat", 1.0, "te|vous ACTE la|les|le CORPS"),
    ("threat", 1.0, "ACTE TON CORPS"),
    ("threat", 1.0, "vais|va|allons|devrait te|vous ACTE"),
    ("threat", 1.0, "te|vous faire taire"),
    ("group", 1.0, "NAME|PEOPLE|ils|gens|elles _ ETRE UN UN? NUISIBLE"),
    ("group", 1.0, "reproduisent|multiplient comme UN NUISIBLE|lapins"),
    ("group", 1.0, "quon|faut|doit|devrait les|ces _ CHASSER"),
    ("group", 1.0, "nont|ont pas|aucune dame|ame|honneur"),
    ("group", 1.0, "volent tout ce"),
    ("sexual", 1.0, "MONTRE nous|moi|TON|les|la _ NU"),
    ("sexual", 1.0, "MONTRE TON|les|la NU"),
    ("sexual", 1.0, "montre nous|moi TON NU"),
    # ---- Ukrainian
    ("insult", 1.0, "ЛАЙКА"),
    ("insult", 1.0, "ТИ ГИДКИЙ* ЗВІР|ЛАЙКА"),
    ("insult", 1.0, "ТИ ГИДКИЙ+"),
    ("insult", 1.0, "ГИДКИЙ+ ЗВІР"),
    ("insult", 1.0, "закрий|заткни|стули|закрийте свою|свій? ПЕЛЬКА"),
    ("insult", 1.0, "закрий|заткни|стули ПЕЛЬКА"),
    ("threat", 1.0, "ТИ БИТИ ТІЛО|ТВІЙ"),
    ("threat", 1.0, "БИТИ ТИ|ТВІЙ ТІЛО?"),
    ("group", 1.0, "NAME|PEOPLE|вони|ці|усі|всі це? НЕЛЮДЬ"),
    ("group", 1.0, "NAME|вони не люди"),
    ("group", 1.0, "треба|слід їх|цих ГЕТЬ"),
    ("group", 1.0, "їх треба|слід ГЕТЬ"),
    ("group", 1.0, "ГЕТЬ їх|цих|геть"),
    ("group", 1.0, "злодії|брехуни|злочинці від|за народження|природи"),
    ("sexual", 1.0, "роздягайся|роздягнися"),
    ("sexual", 1.0, "покажи нам|мені|свої|свою? ТВІЙ? ГОЛА"),
    ("sexual", 1.0, "розсунь|розстав ноги"),
]
