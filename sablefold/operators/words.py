"""Word lists: fixed ones, and those that a caller gives."""

from __future__ import annotations

from pathlib import Path

# Fixed values.
HONORIFICS = "dr mr mrs ms mx miss sir madam prof rev fr".split()
STOP = (
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "new york los angeles san francisco united states america bank statement address salary tesco transfer savings account number card credit debit "
    "city state zip postal code phone email dob date birth mrn patient customer member password username login apple google microsoft amazon meta "
    "hello goodbye yes no page total subtotal tax invoice receipt order issued bill to from subject re fwd reply forward send inbox outbox draft trash "
    "spam welcome settings help profile notifications"
).split()
COUNTRIES = (
    "Afghanistan,Albania,Algeria,Andorra,Angola,Argentina,Armenia,Australia,Austria,Azerbaijan,Bahamas,Bahrain,Bangladesh,Belarus,Belgium,Bolivia,Brazil,"
    "Bulgaria,Cambodia,Cameroon,Canada,Chile,China,Colombia,Costa Rica,Croatia,Cuba,Cyprus,Czechia,Denmark,Dominican Republic,Ecuador,Egypt,El Salvador,"
    "Estonia,Ethiopia,Finland,France,Georgia,Germany,Ghana,Greece,Guatemala,Honduras,Hungary,Iceland,India,Indonesia,Iran,Iraq,Ireland,Israel,Italy,Jamaica,"
    "Japan,Jordan,Kazakhstan,Kenya,Korea,Kuwait,Latvia,Lebanon,Liberia,Libya,Liechtenstein,Lithuania,Luxembourg,Malaysia,Maldives,Mali,Malta,Mexico,Moldova,"
    "Mongolia,Montenegro,Morocco,Myanmar,Nepal,Netherlands,New Zealand,Nicaragua,Nigeria,North Korea,Norway,Oman,Pakistan,Panama,Paraguay,Peru,Philippines,"
    "Poland,Portugal,Qatar,Romania,Russia,Saudi Arabia,Senegal,Serbia,Singapore,Slovakia,Slovenia,South Africa,South Korea,Spain,Sri Lanka,Sudan,Sweden,"
    "Switzerland,Syria,Taiwan,Tajikistan,Tanzania,Thailand,Tunisia,Turkey,Uganda,Ukraine,United Arab Emirates,United Kingdom,United States,Uruguay,Uzbekistan,"
    "Venezuela,Vietnam,Yemen,Zambia,Zimbabwe"
).lower().split(",")

#: The names that dict_semi_join's statement knows.
COMMON_GIVEN = (
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen "
    "christopher lisa daniel nancy matthew betty anthony sandra mark margaret donald ashley steven kimberly andrew emily paul donna joshua michelle "
    "kenneth carol kevin amanda brian melissa george deborah timothy stephanie ronald rebecca jason laura edward helen jeffrey sharon ryan cynthia "
    "jacob kathleen gary amy nicholas angela eric anna jonathan ruth stephen brenda larry pamela justin nicole scott katherine brandon samantha "
    "benjamin christine samuel emma gregory catherine alexander virginia patrick rachel frank carolyn raymond janet jack maria dennis heather jerry diane "
    "priya aanya"
).split()
COMMON_FAMILY = (
    "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson thomas taylor moore jackson martin "
    "lee perez thompson white harris sanchez clark ramirez lewis robinson walker young allen king wright scott torres nguyen hill flores green adams nelson "
    "baker hall rivera campbell mitchell carter roberts gomez phillips evans turner diaz parker cruz edwards collins reyes stewart morris morales murphy "
    "cook rogers gutierrez ortiz morgan cooper peterson bailey reed kelly howard ramos kim cox ward richardson watson brooks chavez wood bennett gray "
    "mendoza ruiz hughes price myers long foster sanders ross sharma shaw patel"
).split()

#: Given and family names: all of the reference's lists, and the common ones.  Longer lists are given as files, see ``read_list``.
GIVEN = COMMON_GIVEN + (
    "aaron abigail adam adrian aisha alan albert alex alexis alice alicia allison amber amelia andrea anita ann anu aria ariana arjun arthur austin ava "
    "beatrice ben beth bethany beverly bill billy bobby bradley briana brianna brittany bruce bryan cameron carl carlos caroline charlie charlotte chloe "
    "chris christian christina cindy clara claudia cody connor craig crystal dan dana danielle darius darryl dawn dean debra denise derek devin diana "
    "diego dominic doris dorothy douglas dustin dylan earl eileen elaine eleanor elena eli elijah elise ella ellen erica erin ethan eugene evan evelyn "
    "fatima felix fiona frances fred gabriel gabriela gail geoffrey gerald gerard gina giselle glenn gloria grace grant greg hannah harold harper harry "
    "hassan hazel henry holly howard ian ibrahim igor ingrid irene isaac isabel isabella isaiah ivan jackson jacqueline jaime jake jamie jane janice "
    "jared jasmine javier jay jean jeff jenna jenny jeremiah jeremy jerome jesse jesus jill jim joan joanna jocelyn joe joel johnny jordan jorge jose "
    "josiah joy joyce juan judith judy julia julian julie june kate kathryn kathy katie katrina kayla keith kelly kelsey ken kim kristen kristin kyle "
    "lauren lawrence lee leo leon leonard leslie lewis liam lila lilian lily lindsay logan lola lori louis louise lucas lucia luis luke lydia lynn "
    "madeline madison maggie malik manuel marc marcus mariana marie marilyn mario marisa marsha martha martin mason maureen max maya megan melanie "
    "meredith mia miguel mike mila miranda mohamed mohammed molly monica morgan murat nadia naomi natalie natasha nathan nathaniel neil nina noah noemi "
    "nora norma olivia omar oscar owen pablo paige paula peter philip phillip phoebe phyllis preston quentin ralph randall randy raul regina renee reza "
    "riccardo riley rita roberto robin rodney roger roman ronnie rosa rose rosemary roy ruben russell sabrina sally salman samir sandy sara saul sean "
    "sebastian selena serena sergio shane shannon shaun shawn sheila shirley shreya sidney sierra simon sofia sonia sophia sophie spencer stacey stacy "
    "stanley stella steve sue suzanne sydney tamara tammy tanya tara taylor teresa terry theodore theresa tiffany tina todd tom tommy tony tracy travis "
    "trevor tyler una valentina valerie vanessa veronica vicki victor victoria vincent walter wanda warren wayne wendy wesley willie xavier yara yasmin "
    "yolanda zachary zara zoe"
).split()
FAMILY = COMMON_FAMILY + (
    "aguilar alvarez andrews armstrong banks barnes bell berry black blake bonner booker bowen boyd bryant burns butler castillo castro chen cheng choi "
    "cohen coleman craig crawford dixon doe doyle duncan ellis fernandez ferreira ferrer fischer fisher fleming ford fox franklin freeman fuller gao "
    "gardner gibson gonzales graham grant griffin gupta hamilton hammond hancock hanson harper harrison hart hayes henderson herrera higgins hoffman "
    "holland holmes hopkins hsu huang hudson hunt hunter ibarra iqbal jacobs james jenkins jensen jiang jimenez kaur kennedy khan kumar lam lambert "
    "lawrence li lin liu lowe luna lynch macias madden marquez marsh mason mcdonald mckenzie mckinney medina mendez meyer mills mohamed moreno murray "
    "norris norton o'brien oliver olson ortega owens pace padilla palmer park patterson pearson perkins pham pierce pope porter powell quinn ray reynolds "
    "rice richards romero rose rossi russell ryan sandoval santiago santos schmidt schneider shen shimizu silva simmons simon singh snyder soto stanley "
    "stein stevens stone suarez sullivan tan tang tran trevino underwood vargas vasquez vega velazquez villa wagner wang warner warren washington weaver "
    "webb weber wells west wheeler wong woods wu xu yang yoon yu zhang zhou zimmerman"
).split()


def read_list(path: str) -> list[str]:
    """Words of a file, one on a line, in lower case; blank lines and those that start with # don't count."""
    lines = (line.strip() for line in Path(path).read_text(encoding="utf-8").splitlines())
    return [line.lower() for line in lines if line and not line.startswith("#")]
