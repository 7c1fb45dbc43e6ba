"""The labelled table of the tagger of names and addresses: sentences as they are, and frames that are filled with names and addresses in turn."""

from __future__ import annotations

from collections.abc import Iterator

# As text: [words|kind] marks an entity. Own sentences in the four languages of the documents, names in running prose among them.
LABELLED = """
My name is [Anna Weber|name] and I work here .
I am called [John Smith|name] , nice to meet you .
Please write to Mr [Peter Brown|name] about it .
Please ask Mrs [Mary Jones|name] tomorrow .
Contact Dr [Alan Green|name] for details .
Dear Mr [Hill|name] , thank you .
Yours sincerely , [Laura Stone|name]
Her name is [Kate Miller|name] .
Last week the letter was signed by [Helen Ford|name] in the office .
The report was written by [Thomas van Dyke|name] and two others .
Yesterday I met [Oliver Grant|name] at the station .
We spoke with [Grace O'Hara|name] about the rent .
The flat belongs to [Martin Cole|name] , who is away .
Our neighbour [Susan Bell|name] called the police .
It was sent to [Jean-Paul Mercer|name] by mistake .
My brother [George|name] lives far away .
Then Ms [Ivy Lane Parker|name] signed the form .
Professor [Nora Field|name] will see you at noon .
He lives at [12 Park Street|address] in town .
The office is at [7 Station Road|address] .
Send it to [221 Baker Street|address] please .
Address : [5 Mill Lane|address]
She moved to [48 Old Church Road|address] last year .
The parcel waits at [9 Green Avenue|address] until Friday .
We met in front of [103 North Hill Drive|address] at six .
Mein Name ist [Karl Huber|name] und ich bin da .
Bitte fragen Sie Herr [Jonas Vogel|name] danach .
Frau [Eva Braun|name] ist heute nicht da .
Gestern traf ich [Sabine Keller|name] am Bahnhof .
Der Brief ist von [Ludwig von Stein|name] unterschrieben .
Wir sprachen mit [Petra Lang|name] über die Miete .
Unser Nachbar [Dieter Kraus|name] rief die Polizei .
Das Haus gehört [Hans-Peter Roth|name] aus dem Dorf .
Ich wohne in der [Hauptstraße 12|address] seit Mai .
Adresse : [Bahnhofstraße 7|address]
Das Büro ist im [Gartenweg 31|address] gleich um die Ecke .
Sie zog in die [Mühlgasse 4|address] um .
Je m'appelle [Marie Dupont|name] et je vis ici .
Monsieur [Paul Martin|name] est parti .
Madame [Claire Petit|name] arrive demain .
Hier j'ai vu [Luc Bernard|name] à la gare .
La lettre est signée par [Anne de la Tour|name] ce matin .
Nous avons parlé avec [Sophie Moreau|name] du loyer .
Notre voisin [Henri Lefort|name] a appelé la police .
Elle habite [14 rue Victor Hugo|address] depuis mai .
Adresse : [8 rue Pasteur|address]
Le bureau est au [27 avenue Jean Moulin|address] près du port .
Me llamo [Carlos Ruiz|name] y vivo aquí .
El señor [Luis Gómez|name] no está .
La señora [Ana López|name] llega hoy .
Ayer vi a [Pedro Castro|name] en la estación .
La carta fue firmada por [María de los Santos|name] esta mañana .
Hablamos con [Elena Vega|name] del alquiler .
Vive en la [calle Mayor 15|address] con su hija .
La oficina está en la [calle del Sol 22|address] cerca del puerto .
The river runs to the sea .
Now we go on with the work .
In the year 1998 there were 12 of them .
This is one of the best . It is not here .
Page 12 of 40
The train to Dover leaves at 9 and the one to London at 10 .
On Monday the Bank of the North was closed .
It was written by the Council and sent to Parliament .
We met at the Museum . The Old Bridge was closed .
He spoke with the Minister about Europe .
The letter was signed by the Board on 3 May 2004 .
Yesterday was Sunday . Then came Winter .
Our school is in Kent and the Hospital is in York .
Ist das nicht die Zeit der Menschen und der Dinge ?
Die Stadt und der Fluss sind alt .
Zwei Männer gehen in den Wald .
Gestern fuhr der Zug nach Bremen um 12 Uhr ab .
Der Brief ist von der Bank und vom Amt .
Wir sprachen mit dem Lehrer über das Haus .
Das Haus gehört der Stadt und dem Verein .
Les enfants et la mer . Une maison est là .
De la terre et du vent dans les arbres .
Hier le train pour Lyon est parti à 9 heures .
La lettre est signée par le Conseil .
Nous avons parlé avec le maire de la ville .
El agua y la tierra de los campos .
No hay nada que hacer en la casa .
Ayer vi a la gente en la plaza de Sevilla .
La carta fue firmada por el Consejo .
See Figure 3 and Table 4 .
Walking along we saw them .
Reading is fun , it is Monday .
Houses stand here . Trees grow there .
Every Morning the Bells of Dover ring .
ANOTHER DAY HAS GONE !
Then . Slowly . Quiet Rivers Run Deep
North | South | East | West
Again Again Again Again Again Again Again
Und Und Und Und Und Und Und Und Und
He is Captain of the Ship and she is Queen .
Zusammen gehen Kinder in Schulen und Gärten .
Langsam . Morgen kommt Besuch aus Bremen .
Toujours là . Demain Paris et Lyon se lèvent .
Siempre igual . Mañana Madrid y Sevilla esperan .
There were 14 Ducks and 3 Geese at 9 Ponds .
Take 12 of 30 Steps and 5 Cups .
the rules of the Game are in Part Two .
Dentro de la casa hay sol . Cerca del mar vive gente . Antes de los meses de lluvia todo cambia .
Después la mujer sale . Detrás de él hay un muro . Fuera de la ciudad .
Autour de la table on parle . Avant la nuit tout change . Plus de pain pour nous . Loin de là .
Wegen der Hitze blieb man drin . Unter der Brücke fließt Wasser . Vor der Tür . Neben der Straße .
Today , we rest . Yes , it is so . Often , as we know , it rains . Well , well , Well , Well .
Heute , sagte er , regnet es . Ja , gern . Leider , so heißt es , zu spät .
Parfois , il pleut . Oui , c'est ici . Ensuite , on mange .
Luego , todo cambia . Sí , claro . Además , hay pan .
Rivers . Slowly . Nothing | Evening ! Outside
Stille . Niemals . Morgen ! Draußen
Demain . Jamais ! Toujours | Dehors
Nunca . Siempre ! Mañana | Afuera
Home again . Wind and rain . Bread , milk and salt .
Haus und Hof . Wind und Regen .
Vent et pluie . Lluvia y viento .
Ring 020 555 - 0101 Thursday or + 44 ( 20 ) 555 - 0102 Friday .
"""

# Frames: {n} takes a full name, {f} one with initials, {g} a given name, {s} a family name, {a} an address. Groups by language, which decides what fills them.
FRAMES = {
    "en": """
{n} was late again and missed the bus .
{n} has two sons and a daughter .
{n} opened the window .
{n} said nothing for a while .
{n} lost her wallet at the market .
{n} , the mayor , spoke first .
{n} , a nurse from the north , agreed .
{n} and {n} run a small bakery .
{n} or {n} can open the door .
I saw {g} yesterday .
Tell {g} that we are ready .
The teacher praised {n} for the drawing .
The driver , {n} , was not hurt .
The owner , {n} , wants to sell .
A letter to {n} came back .
A call from {n} woke us up .
A poem by {n} was read aloud .
{f} paid in cash .
A note from {f} arrived .
The house of {n} is old .
The songs of {n} are sad .
The father of {n} was a sailor .
{n}'s garden is full of roses .
This is {n} speaking .
Have you heard from {n} lately ?
Did {n} pay the bill ?
Where is {n} now ?
As {n} put it , nothing is certain .
But {n} did not answer .
Then {n} closed the shop .
In May {n} moved to another town .
On Sunday {n} sang in the choir .
Later {n} became a pilot .
With {n} in goal they felt safe .
We invited {n} to the wedding .
They accused {n} of fraud .
People like {n} are rare .
She is engaged to {n} .
He works for {n} and earns well .
It is up to {n} to decide .
Ask for {n} at the desk .
Best wishes , {n}
Regards , {n}
Signed : {n}
Customer : {n}
Contact person : {n}
Employee : {n}
Mr. {s} was ill last week .
Mrs. {s} has a question .
Ms. {s} will call back .
Dr. {s} is on holiday .
Prof. {n} gave a talk .
President {s} signed it .
Captain {n} took command .
Judge {s} closed the case .
Sir {n} wrote three plays .
Uncle {g} told a story .
My wife {g} is a baker .
His son {g} is seven .
The actress {n} lives abroad .
The singer {n} was born here .
Coach {n} is proud .
{n} lives at {a} with two dogs .
{a} is empty now .
The clinic at {a} opens at nine .
They live at {a} now .
Our new office , {a} , is bright .
I grew up at {a} .
The meeting is at {a} tonight .
Come to {a} at eight .
Home address : {a}
Delivery address : {a}
A car was seen near {a} .
Please bring the boxes to {a} .
The bank on {a} was robbed .
The school in {a} is new .
""",
    "de": """
{n} kam zu spät zur Arbeit .
{n} hat zwei Söhne und eine Tochter .
{n} und {n} kochen gern .
{n} sagte lange nichts .
Heute hat {n} frei .
Dann schloss {n} den Laden .
Der Fahrer , {n} , blieb ruhig .
Die Lehrerin lobte {n} für das Bild .
Ein Brief an {n} kam zurück .
Ein Anruf von {n} weckte uns .
Die Lieder von {n} sind traurig .
{f} lehrt hier .
Der Vater von {n} war Bäcker .
Ich habe {n} lange nicht gehört .
Wo ist {n} jetzt ?
Ohne {n} geht es nicht .
Mit {n} macht es Spass .
Herr {s} ist krank .
Frau {s} hat eine Frage .
Herr Prof. {s} hält die Rede .
Frau Dr. {n} ruft zurück .
Viele Grüße , {n}
Kunde : {n}
Name : {n}
Mein Onkel {g} erzählt viel .
Sie ist mit {n} verlobt .
Man hat {n} zum Fest geladen .
{n} wohnt in der {a} mit einem Hund .
Die Praxis in der {a} ist zu .
Wir sehen uns vor dem {a} um acht .
Anschrift : {a}
Bringen Sie alles in die {a} morgen .
Ich bin in der {a} groß geworden .
Das Haus {a} steht leer .
""",
    "fr": """
{n} est arrivé en retard .
{n} a deux fils et une fille .
{n} et {n} aiment le pain .
{n} n'a rien dit .
Puis {n} a fermé la porte .
Le chauffeur , {n} , va bien .
La maîtresse a félicité {n} pour le dessin .
Une lettre à {n} est revenue .
Un appel de {n} nous a réveillés .
Les chansons de {n} sont tristes .
Le père de {n} était marin .
Où est {n} maintenant ?
Sans {n} rien ne marche .
Avec {n} on rit beaucoup .
M. {s} est malade .
Mme {s} a une question .
Le professeur {n} parle ce soir .
Bien à vous , {n}
Client : {n}
Nom : {n}
Mon oncle {g} raconte tout .
Elle est fiancée à {n} .
On a invité {n} à la fête .
{n} habite au {a} avec un chien .
Le cabinet du {a} est fermé .
Rendez-vous devant le {a} à huit heures .
Adresse de livraison : {a}
Portez tout au {a} ce matin .
J'ai grandi au {a} .
""",
    "es": """
{n} llegó tarde otra vez .
{n} tiene dos hijos y una hija .
{n} y {n} cocinan bien .
{n} no dijo nada .
Luego {n} cerró la puerta .
El chófer , {n} , está bien .
La maestra felicitó a {n} por el dibujo .
Una carta para {n} volvió .
Una llamada de {n} nos despertó .
Las canciones de {n} son tristes .
El padre de {n} era marinero .
¿ Dónde está {n} ahora ?
Sin {n} nada funciona .
Con {n} todo es fácil .
Sr. {s} está enfermo .
La Sra. {s} tiene una pregunta .
El profesor {n} habla esta noche .
Saludos , {n}
Cliente : {n}
Nombre : {n}
Mi tío {g} cuenta historias .
Está casada con {n} desde abril .
Invitaron a {n} a la fiesta .
{n} vive en la {a} con un perro .
La clínica de la {a} está cerrada .
Nos vemos frente a la {a} a las ocho .
Dirección : {a}
Lleve todo a la {a} mañana .
Crecí en la {a} .
""",
}
GIVEN = {
    "en": "Adam Alice Arthur Barbara Ben Caroline Charles Chloe Daniel Deborah Donald Dorothy Eric Esther Frank Georgia Harold Irene Jack Julia Keith Linda Malcolm Megan Nigel Pamela Ralph Ruth Samuel Sheila Theo Vera Omar Aisha Ming Yuki Raj Anjali Ivan Olga Kofi Zainab Hiro Leila Dmitri Jin",
    "de": "Albert Bettina Bernd Christa Detlef Elke Erich Gisela Gerhard Heike Holger Inge Jürgen Katrin Lothar Margit Norbert Renate Rüdiger Silke Torsten Ursula Volker Waltraud",
    "fr": "Alain Brigitte Bruno Cécile Denis Élodie Fabien Geneviève Guillaume Jacqueline Laurent Louise Marc Martine Pascal Pauline Rémi Sylvie Thierry Véronique Yves Zoé",
    "es": "Alberto Alicia Antonio Blanca Diego Dolores Emilio Esperanza Felipe Gabriela Ignacio Inés Jorge Josefa Manuel Marta Óscar Pilar Rafael Raquel Tomás Victoria",
}
FAMILY = {
    "en": "Adams Atkinson Barker Bennett Cooper Davidson Ellis Ferguson Gibson Harrison Ibrahim Jenkins Kowalski Lambert MacDonald Murphy Nakamura Norton O'Neill Palmer Peterson Robinson Rossi Sanders Singh Taylor Thompson Underwood Wallace Watkins Zhang Zhou Ali Khan Kim Nguyen Okoye Mensah Gupta Reddy Ivanov Popov Svensson Hansen Wu Ho",
    "de": "Becker Bergmann Dietrich Ebert Fischer Friedrich Graf Günther Hartmann Hoffmann Jansen Kaufmann Krämer Lehmann Neumann Pfeiffer Richter Schneider Schröder Simon Vogt Weiß Zimmermann Ziegler",
    "fr": "Aubert Barbier Bertrand Boucher Chevalier Colin Delacroix Dubois Fontaine Garnier Gauthier Lambert Leclerc Leroy Mercier Meunier Morel Picard Robin Rousselot Simonet Vasseur",
    "es": "Aguilar Blanco Campos Delgado Domínguez Fernández Flores Gutiérrez Hernández Iglesias Jiménez Martínez Medina Moreno Núñez Ortega Pérez Ramírez Rubio Santana Soto Vázquez",
}
PLACES = {
    "en": ["{} Church Street", "{} Green Lane", "{} London Road", "{} Park Avenue", "{} Oak Drive", "{} Bridge Close", "{} Market Square", "{} Castle Hill", "{} Abbey Court", "{} St Mary's Way", "{} Spring Gardens", "{} Lower Mill Street"],
    "de": ["Schulstraße {}", "Lindenweg {}", "Kirchgasse {}", "Marktstraße {}", "Waldweg {}", "Schillerstraße {}", "Am Markt {}", "Ringstraße {}"],
    "fr": ["{} rue de la Paix", "{} avenue Victor", "{} rue Gambetta", "{} boulevard Voltaire", "{} place du Marché", "{} rue du Moulin", "{} chemin des Vignes"],
    "es": ["calle Sol {}", "calle de la Paz {}", "avenida Central {}", "plaza Mayor {}", "calle San Juan {}", "paseo del Prado {}"],
}
# Sentences without an entity whose capitals and numbers could be mistaken for one.
PLAIN = """
The Red Cross sent tents and water .
The Atlantic Ocean is wide and the Alps are high .
They flew from Paris to Madrid in September .
The University of Leeds has a new library .
West Germany won the World Cup that year .
Saint Petersburg and Hong Kong are ports .
The Supreme Court ruled in favour of the State .
The Evening Post costs 2 pounds .
The First World War ended in November .
Los Angeles lies in California .
Chapter 7 : The Long Night
Table 3 shows the results for January and February .
Gate 4 is next to Hall 9 .
Platform 2 is closed until Monday .
Apollo 11 reached the Moon in July .
Between 10 and 20 Guests came on Saturday .
Add 3 Spoons of Sugar and 200 grams of Flour .
Our Terms have changed . Your Privacy Matters .
How To Build A Better House
The Best Songs Of The Year
Click Here To Read More
The text stands under the Creative Commons License , version 2 .
It was printed by the National Public Library and the General Post Office .
All Rights Reserved
North Korea and Japan play on Wednesday .
English and French are taught here .
Many Russians and Poles live in Canada .
The Central Station is near the Town Hall .
The Sun and the Moon are round .
God knows what Heaven is .
Thunder came and Rain fell on Hills and Fields .
Apple and Microsoft sell computers .
Die Bank am Markt hat am Montag zu .
Der Zug von Köln nach Berlin hat Verspätung .
In der Schule lernen Kinder Deutsch und Englisch .
Die Regierung in Wien plant neue Gesetze .
Nach dem Essen gab es Kaffee und Kuchen .
Auf dem Tisch liegen Messer , Gabel und Löffel .
Er trinkt Wasser , Tee und Bier .
Seit dem Krieg lebt die Familie in Polen .
Am Abend kam der Arzt mit dem Auto .
Am Freitag um 9 Uhr beginnt der Unterricht .
Im Jahr 1990 wurde Deutschland wieder ein Land .
Zimmer 12 ist frei und Zimmer 14 auch .
Die Vereinten Nationen tagen in Genf .
Viel Glück und alles Gute zum Geburtstag .
Seite 3 von 20
L'Italie et la Suisse sont voisines .
Le roi est allé à Rome en avril .
La Seine passe par Paris et Rouen .
Les Alpes sont plus hautes que les Vosges .
Le Monde est un journal .
La Banque de France a baissé ses taux en mars .
Page 4 sur 12
La salle 14 est au bout du couloir .
Noël et Pâques sont des fêtes .
Il y a 15 garçons et 12 filles .
España y Portugal son vecinos .
El rey viajó a Roma en abril .
El Banco de España bajó los tipos en marzo .
El Tajo pasa por Toledo y Lisboa .
La Navidad y la Pascua son fiestas .
Página 4 de 12
La sala 14 está al fondo .
El Ministerio de Cultura abrió un museo en Sevilla .
Se venden 20 mesas y 4 sillas .
Silence ,
Slowly , then faster .
Evening : rain and wind .
And then it rained . Or so they say . But it was late . So it goes . Yet nothing moved .
Of course not . From here on it is easy . Is it far ? Are we there ? In the end it worked . On the way home . At last . To be fair , no .
That was all . Those were the days . With time it heals . An hour went by . Be quiet . By then it was dark . For once it was warm . Once more . If only .
My cat sleeps . Your dinner is ready . Some people like rain . Many a day went by . Another train came . Each room has a bed . What a day !
Im Winter schneit es oft . Am Morgen singen Vögel . Das Wetter ist gut . Meine Katze schläft . Unser Hund bellt . Ein Kind lacht . Eine Tür knarrt . Kein Mensch kam .
Zum Glück regnet es . Beim Essen liest er . Ins Kino ging keiner . Diese Blumen welken . Seine Hände zittern . Ihre Augen leuchten . Alle Fenster klirren . Viele Jahre vergingen .
Le temps est beau . La neige tombe . Mon chat dort . Ma porte grince . Un enfant rit . Une cloche sonne . Ces fleurs fanent . Au matin il gèle . Du pain et du sel . Aux armes ! En hiver tout dort .
El tiempo es bueno . La nieve cae . Mi gato duerme . Tu puerta cruje . Un niño ríe . Una campana suena . Estas flores se secan . Al alba hiela . En invierno todo duerme . Con pan y sal .
Buenos Aires es la capital de Argentina .
Estados Unidos y México firmaron el tratado .
"""


def sentences(fills: int = 3) -> Iterator[str]:
    """All lines of the table: those as they are, and each frame filled `fills` times. Names and places go round, family names one step faster, so pairs vary."""
    yield from LABELLED.splitlines()
    yield from PLAIN.splitlines()
    for language, text in FRAMES.items():
        given, family, places = GIVEN[language].split(), FAMILY[language].split(), PLACES[language]
        turn = 0
        for frame in filter(None, text.splitlines() * fills):
            for slot in ("{n}", "{f}", "{g}", "{s}", "{a}"):
                while slot in frame:
                    g, s = given[turn % len(given)], family[(turn + turn // len(given)) % len(family)]
                    number = 1 + turn * 37 % 240
                    own = {"{n}": f"[{g} {s}|name]", "{f}": f"[{g[0]}. {s[0]}. {s}|name]" if turn % 2 else f"[{g[0]}. {s}|name]", "{g}": f"[{g}|name]", "{s}": f"[{s}|name]", "{a}": f"[{places[turn % len(places)].format(number)}|address]"}[slot]
                    frame = frame.replace(slot, own, 1)
                    turn += 1
            yield frame
