"""Sentences to measure the abuse score on wording that its labels do not hold.

Written after the first version of the lexicons. Not a clean held-out set: the register
list was edited and settings of the model were chosen after results on it were seen.
"""

ABUSIVE = [
    "Those newcomers are a plague and ought to be thrown out of our town for good.",
    "I am coming round tonight and you will regret it, I promise.",
    "You are the most pathetic, worthless liar who ever wrote a line here.",
    "Somebody should smash your skull with a hammer, you filthy coward.",
    "All these immigrants are rats that infest the whole quarter.",
    "He is a disgusting pervert and his wife is a cheap whore.",
    "Shut your stupid mouth, editor, before I shut it for you.",
    "I know your address and I will burn your house with your children inside.",
    "Women are too dumb to drive and should never be allowed out of the kitchen.",
    "She got down on her knees and took his hard cock between her wet lips.",
    "Hot nude girls waiting for you on webcam, click here for free porn.",
    "Every last one of them deserves to hang, they are animals and not people.",
    "You st*pid b!tch, go and die already.",
    "y o u   u g l y   m o r o n",
    "What a bunch of brainless cretins run this page, you all stink.",
    "Jews and gypsies must be expelled, they are parasites and nothing else.",
    "I hope you choke on your own blood, you miserable bastard.",
    "Your mother is a slut and your father is a drunk loser.",
    "We are going to stab you behind the station, watch out.",
    "Nobody likes you, you are garbage, just kill yourself.",
    "Du bist der dümmste Trottel, den ich je gesehen habe, halt endlich dein Maul.",
    "Diese Ausländer sind Ungeziefer und müssen alle raus aus unserem Land.",
    "Ich komme heute Nacht zu dir und schlage dir die Zähne ein.",
    "Sie zog sich nackt aus und leckte seinen geilen Schwanz.",
    "Der Autor ist ein widerlicher Lügner und ein feiges Schwein.",
    "Tu n'es qu'un sale menteur et un lâche, ferme donc ta grande gueule.",
    "Ces étrangers sont des cafards, il faut tous les chasser d'ici.",
    "Je vais venir chez toi ce soir et t'égorger comme un porc.",
    "Elle baise avec tout le monde, cette grosse salope.",
    "L'auteur est un crétin fini, il mérite de crever seul.",
    "Eres un mentiroso asqueroso y das vergüenza a tu madre, cállate.",
    "Los inmigrantes son una plaga y hay que expulsar a todos.",
    "Esta noche voy a ir a tu casa y te voy a apuñalar.",
    "Esa puta se folla a cualquiera, qué asco de mujer.",
    "El autor es un payaso estúpido que merece una paliza.",
]

NEUTRAL = [
    "The novel describes how the old miller kills a pig and sells the meat at the market.",
    "Rats and cockroaches spread the disease through the sewers of the city in 1854.",
    "The court convicted him of murder and sentenced him to death; the appeal was dismissed.",
    "Sexual reproduction in this species begins in spring, when the males display to the females.",
    "In the painting a naked woman stands beside a fountain, watched by two men.",
    "Refugees and migrants settled in the northern quarter after the war and opened shops.",
    "The parasite infests the intestines of sheep and causes severe disease in lambs.",
    "The battle left many dead, and the bodies were buried in the field behind the church.",
    "Dick Turner played the idiot brother in the comedy, which critics found stupid but harmless.",
    "Patients with vaginal bleeding should be examined by a physician within a week.",
    "The law banned the slaughter of animals on public streets and removed the stalls.",
    "The band's album Kill the Noise reached number four; its single Dirty Hands sold well.",
    "The bird known as the great tit lays eight eggs; the blue-footed booby lays two.",
    "Women were not allowed to vote in the canton until 1971.",
    "He was stabbed in the street in 1888 by a stranger who was never found.",
    "If the process receives no signal, the kernel kills it and its children.",
    "Die Pest tötete im Jahr 1349 ein Drittel der Bevölkerung der Stadt.",
    "Das Gericht verurteilte den Mann wegen Mordes zu lebenslanger Haft.",
    "Le roman raconte la mort d'un soldat pendant la guerre de 1914.",
    "La novela narra la vida de una mujer que muere en la cárcel.",
    "The village hopes to find money for a new road; people from the district support it.",
    "You should see the chapel first, then walk down to the harbour where the boats wait.",
    "The editor of the journal was known for careful work and a warm welcome to new authors.",
    "qwe qwe lalala hello hello this is my first test of the page",
    "Essex and Sussex share a dialect; Scunthorpe lies farther north.",
]

FILLER = [
    "The parish lies on the eastern bank of the river and covers about twelve square kilometres.",
    "Its church was rebuilt after a fire and has a tower of local stone.",
    "A weekly market was first recorded in 1342 and is still held in the square.",
    "The railway reached the town in 1871, and a mill opened four years later.",
    "According to the census, most people work in farming, trade and tourism.",
    "The school was founded by a merchant and moved to its present site in 1926.",
]
