"""Sentences whose frames are not in the labelled table of the tagger; written before the tagger's features were chosen, never learned from."""

HELD_OUT = """
[Sarah Mitchell|name] joined the company three years ago .
According to [Robert Chen|name] , prices will keep rising .
[Ahmed Hassan|name] and [Li Wei|name] met for lunch .
The parcel for [David Okafor|name] was left at [48 Elm Avenue|address] .
Mr. [James Foster|name] declined to comment .
Dr. [Patel|name] prescribed a new drug .
Nobody has seen [Emma Lindqvist|name] since the party .
Give the keys to [Oscar Whitfield|name] before noon .
[Fatima Noor|name] won the race by two seconds .
The book by [Eleanor Vance|name] sold well .
A photo of [Hugh Tanner|name] hung above the desk .
[Priya Sharma|name] , aged 34 , teaches chemistry .
When [Leo Marchetti|name] arrived , dinner was cold .
Is [Nadia Petrov|name] still waiting outside ?
I have known [Walter Briggs|name] since school .
Thanks to [Imogen Clarke|name] the roof was repaired .
The winner , [Tomasz Nowak|name] , thanked his coach .
[Gordon Blake|name] bought a boat and sold his car .
Police want to question [Derek Vaughn|name] about the theft .
Without [Hannah Schultz|name] the team looked lost .
Invoices should be addressed to [Beatrice Lowe|name] .
Sincerely , [Philip Marsh|name]
Kind regards , [Amara Obi|name]
Patient : [Kenneth Doyle|name]
Name : [Yvonne Carter|name]
Tenant : [Stuart Reid|name] , since 2012
The judge asked [Miriam Katz|name] to sit down .
[Connor Walsh|name]'s bicycle was stolen on Friday .
They named [Isabel Quinn|name] head of the project .
She married [Edward Lyle|name] in June .
Both [Simon Frost|name] and his wife are doctors .
Lawyers for [Gloria Mendes|name] filed an appeal .
After the storm [Neil Crawford|name] fixed the fence .
An email from [Janet Holloway|name] explained the delay .
Even [Patrick Byrne|name] laughed at that .
Mrs. [Olive Thornton|name] keeps bees .
The painter [Felix Aumann|name] was born in Vienna .
My cousin [Rachel Stein|name] studies law .
[J. R. Hartley|name] wrote about fishing .
Deliver it to [17 Orchard Close|address] after five .
A fire broke out at [230 Kings Road|address] last night .
Their house , [6 Rosemary Lane|address] , is for sale .
The shop on [91 Queen Street|address] closes early .
Turn left and stop at [35 Chapel Hill|address] .
Meet me outside [14 Victoria Square|address] .
Billing address : [502 Maple Drive|address]
[Wolfgang Reuter|name] spielt seit Jahren Geige .
Laut [Monika Seidel|name] war die Tür offen .
Niemand hat [Stefan Albrecht|name] gesehen .
Das Buch von [Ingrid Baumann|name] liegt auf dem Tisch .
Nach der Arbeit ging [Klaus Winter|name] nach Hause .
Herr Dr. [Ulrich Wagner|name] operiert heute .
Mit freundlichen Grüßen , [Anja Pohl|name]
Gestern gewann [Matthias Krüger|name] das Rennen .
Der Anwalt von [Birgit Lorenz|name] schwieg .
Die Firma sitzt in der [Rosenstraße 18|address] .
Treffpunkt ist vor der [Goethestraße 3|address] .
Liefern Sie es bitte in den [Birkenweg 22|address] .
[Camille Rousseau|name] chante dans un chœur .
Selon [Mathieu Girard|name] , tout va bien .
Personne n'a vu [Nicolas Fabre|name] depuis hier soir .
Le livre de [Hélène Marchand|name] est un succès .
Le docteur [Olivier Blanc|name] arrive à midi .
Cordialement , [Isabelle Renard|name]
Le médecin de [Gérard Perrin|name] est absent .
La boutique se trouve au [45 rue Lafayette|address] .
Livrez le colis au [12 avenue Foch|address] demain .
Un incendie a détruit le [3 rue des Lilas|address] .
[Javier Molina|name] trabaja en un banco .
Según [Lucía Herrera|name] , la puerta estaba abierta .
Nadie ha visto a [Miguel Torres|name] desde ayer .
El libro de [Carmen Navarro|name] es muy bueno .
El abogado de [Andrés Peña|name] no quiso hablar .
Atentamente , [Beatriz Romero|name]
El doctor [Sergio Vidal|name] llega a mediodía .
La tienda está en la [calle Luna 7|address] .
Entregue el paquete en la [calle de Toledo 101|address] .
The Royal Society met in London on Tuesday .
New York is larger than Boston .
She studied at Oxford University before the war .
In April the Bank of England raised rates .
The Pacific Ocean covers a third of the Earth .
Sales rose by 12 percent in March and 15 percent in May .
He reads the Daily Telegraph every Sunday .
Chapter 4 describes the Second World War .
Where do Birds sleep when Winter comes ?
The Prime Minister flew to Berlin with 30 Advisers .
Christmas is near and Easter is far .
Terms and Conditions apply to all Orders .
South Africa and Brazil signed the Treaty .
Room 215 is on the second floor .
Flight 370 left Gate 12 at noon .
Most Germans like Bread and Cheese .
The Grand Hotel has 90 rooms .
Version 2 of the Software runs on Linux .
Bring 2 Eggs , 3 Onions and 1 Lemon .
Please Read The Following Instructions Carefully
Monday | Tuesday | Wednesday
Der Bundestag hat das Gesetz im Juni beschlossen .
Die Polizei sucht Zeugen für den Unfall .
Im Sommer fahren viele Leute nach Italien .
Der Preis für Brot und Milch ist gestiegen .
Das Konzert beginnt um 20 Uhr in der Kirche .
Meine Mutter kauft Äpfel , Birnen und Kirschen .
La France et l'Espagne ont signé un accord .
Le président a visité Berlin en janvier .
Le Sénat a voté la loi en juin .
Il y a 40 chaises et 10 tables dans la salle .
El Gobierno aprobó la ley en enero .
La Universidad de Salamanca es muy antigua .
El río Ebro pasa por Zaragoza .
Hay 25 alumnos y 2 maestros en la clase .
"""
