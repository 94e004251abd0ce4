"""Sentences written after the lexicon and its rules, to measure them on wording they were not made for.

The first set was measured once (30 of 42 abusive ones found, 1 of 42 civil ones taken for abuse) and then read to
add terms and rules, so it only guards against loss now. The second was written after that and nothing was changed
to fit it.
"""

ABUSIVE = """
You absolute halfwit, sit down before you hurt yourself.
The secretary is a drunken slob and a cheat.
Crawl back under your rock, you slimy little worm.
Nobody asked you, fatso.
He has the intelligence of a boiled potato.
Were you born this stupid or did you practise?
Your speech made my dog throw up, you cretin.
That woman is a worthless, lying witch.
Go and choke on your own tongue.
We will burn your car and then your shop.
One more word and I will break every bone in your body.
Someone ought to put a bullet in his head.
You had better check under your car tomorrow.
I am going to cut you into pieces.
We know where your daughter goes to school.
The Marrowans are filthy animals and should be driven into the sea.
Immigrants are a plague on this land.
All gypsies are thieves.
Those cripples are a burden and should be put down.
Homosexuals are disgusting perverts.
Women are too stupid to vote.
Jews are poisoning our children.
Send the whole filthy tribe back to where it came from.
Muslims are nothing but savages.
Take your knickers off and come here.
I would love to see those tits bouncing.
She was on her knees sucking his dick.
Come and sit on my face, sweetheart.
He put his hand up her skirt and she was soaking wet.
Nice arse on that clerk.
Halt die Fresse, du Penner.
Du bist so dumm wie ein Esel.
Ich schlage dir die Zähne ein.
Die Türken sind Abschaum.
T'es vraiment une grosse conne.
Je vais te casser la gueule.
Les migrants sont des parasites.
Ти паршивий собако.
Я тобі зламаю ноги.
What a b1tch she is.
You f*cking disgrace.
Get out of here, you i d i o t.
""".strip().split("\n")

CIVIL = """
The honourable member is mistaken on every count.
I have never heard a weaker argument in this chamber.
The minister has failed the farmers of the valley.
Pig farmers lost a third of their herds to the disease.
The rats in the harbour warehouse must be exterminated.
The dog bit the postman on the leg.
Our hospitals treat rape victims without charge.
The report describes sexual abuse in detail and asks for more officers.
He was found guilty of murder and sentenced to life.
The clinic offers tests for infections of the penis and the vagina.
Muslims, Jews and Christians signed the same petition.
The Marrowans have lived here for centuries and belong with us.
The word idiot was struck from the record.
She reported that a man had shouted racist slurs at her.
A group of women are waiting in the gallery to be heard.
The old cow shed will be pulled down next spring.
This plan is a waste of money and the house knows it.
The snake was found in a sack near the bridge.
I withdraw the remark and apologise to the lady.
The knife was used to cut the rope.
We must kill this bill before it reaches the upper house.
The heat will break records this summer.
If the river floods again it will drown the lower fields.
The bitch gave birth to seven puppies.
A bag of manure costs four crowns.
The deputy kept her head while others lost theirs.
Their cattle were shot because of the plague.
He is no fool, and he knows the figures.
Nobody should be expelled for what they believe.
Refugees are people like you and me.
The prick of the needle is over in a second.
Cock fighting was forbidden in the last century.
You are wrong, and I will show you why.
Shut the door, please.
Sie haben das Wort, Herr Minister.
Die Schweine wurden am Montag geliefert.
Le chien du berger est vieux.
Ces mesures sont insuffisantes.
Шановний пане депутате, ви помиляєтеся.
Свині на фермі здорові.
The patient undressed and lay down for the examination.
The breast cancer unit opens in June.
""".strip().split("\n")

SECOND_ABUSIVE = """
What a gutless pack of traitors you are.
My neighbour is a fat, lazy slag.
You people make me want to puke, you spineless weasels.
Piss off back to your hovel.
She is nothing but a two-faced liar and a crook.
His brain is the size of a pea.
I hope somebody strangles you in your sleep.
We shall hang you from the nearest lamp post.
Try that again and we will smash your windows and your skull.
They ought to be shot, every last one of those filthy Zarnians.
Disabled people are useless parasites.
Those savages breed like rabbits.
Blacks should be sent back to the jungle.
The Ketts have no honour and no brains.
Pull up your skirt and let us have a look.
I bet she moans like a whore.
He whipped out his cock in the lift.
You dirty little slut, bend over.
Du feige Sau, verpiss dich.
Diese Ausländer sind Ungeziefer.
Espèce de sale porc, va te faire foutre.
On va brûler ta maison.
Закрий пельку, тупий осел.
Sit down, you m0r0nic w*nker.
""".strip().split("\n")

SECOND_CIVIL = """
The traitor in the play is punished in the last act.
The lazy river is a danger to swimmers in June.
A pack of wolves was seen near the village.
He fell from the lamp post and broke his leg.
The windows were smashed in the storm.
Disabled people deserve the same wages as everybody else.
Rabbits breed fast and ruin the crop.
The jungle covers half of the southern province.
The Ketts have asked for a school of their own.
The skirt factory closed in 1998.
Sex education begins at the age of eleven.
The prosecution says the threat was written on a wall.
You may not call another member a liar in this house.
He called them vermin, and he was rightly expelled for it.
The ass is a patient animal.
Your amendment is stupid policy, with respect.
The cock crows at dawn.
Die Ausländer in unserer Stadt zahlen Steuern.
Le porc est vendu au marché de Lyon.
Осел стояв біля воріт.
Dirty water made forty children ill.
I hope the minister sleeps well.
The poor old woman next door was robbed.
They will hang the painting in the hall.
""".strip().split("\n")
